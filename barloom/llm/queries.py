"""The registered queries of the training-data operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from barloom.llm.decontaminate import OP7_SQL, op7_benchmark_decontamination
from barloom.llm.fim import OP11_SQL, op11_fill_in_middle
from barloom.llm.langid import op5_language_id
from barloom.llm.licenses import op3_license_scan
from barloom.llm.media import op10_media_columns
from barloom.llm.mixing import op9_mixing
from barloom.llm.neardup import op6_near_duplicates
from barloom.llm.neighbours import op13_nearest_neighbours
from barloom.llm.periodic import op12_periodic_runs
from barloom.llm.quality import op1_quality_classifier
from barloom.llm.tokencounts import op2_token_counts
from barloom.llm.toxicity import op8_toxicity
from barloom.llm.urls import OP4_SQL, op4_url_filter

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_counts": op2_token_counts,
    "op3_license_scan": op3_license_scan,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_media_columns": op10_media_columns,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

ORACLES: dict[str, str] = {
    "op4_url_filter": OP4_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op11_fill_in_middle": OP11_SQL,
}
