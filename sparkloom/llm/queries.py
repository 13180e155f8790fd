"""The queries of this subpackage, as ``__spark_entry__`` registers them, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_alignment
from .licences import ORACLE_LICENCES, op2_licences
from .linededup import op4_linededup
from .lmscore import op6_lmscore
from .mixing import op5_mixing
from .packing import op8_packing
from .quality import op3_quality
from .rules import op9_rules
from .simhash import op1_simhash
from .spelling import op11_spelling
from .tokencount import op7_tokencount
from .tokenfiles import op12_tokenfiles
from .topk import ORACLE_TOP_K, op10_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_licences": op2_licences,
    "op3_quality": op3_quality,
    "op4_linededup": op4_linededup,
    "op5_mixing": op5_mixing,
    "op6_lmscore": op6_lmscore,
    "op7_tokencount": op7_tokencount,
    "op8_packing": op8_packing,
    "op9_rules": op9_rules,
    "op10_topk": op10_topk,
    "op11_spelling": op11_spelling,
    "op12_tokenfiles": op12_tokenfiles,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_licences": ORACLE_LICENCES,
    "op10_topk": ORACLE_TOP_K,
}
