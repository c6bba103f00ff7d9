"""The functions of this package by name in Spark SQL, and the tables of a lexicon as views and table functions.

Forms become SQL functions whose bodies Catalyst inlines, so they cost what the column expressions cost. Similarities
are Arrow-batched functions. Null names give what the column expressions give.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions import distance, text
from .operators.lexicon import Lexicon

#: SQL name, result type, form.
FORMS = (
    ("name_strip_accents", "STRING", text.strip_accents),
    ("name_prefix", "STRING", text.prefix_of),
    ("name_core", "STRING", text.core_of),
    ("name_norm", "STRING", text.normalize),
    ("name_skeleton", "STRING", text.skeleton),
    ("name_cologne", "STRING", text.cologne),
    ("name_spell_out", "ARRAY<STRING>", text.spell_out),
)
PAIRS = {"name_edit": distance.weighted_edit, "name_jaro": distance.jaro, "name_similarity": distance._blend}

_LITERAL_OR_OPERATOR = re.compile(r"""('(?:[^'\\]|\\.)*')|(?<![\w`])(in|and|or|not|!|[=<>+*/%|&-]+)\(""", re.IGNORECASE)


def body(form: Column) -> str:
    """A column as SQL text: operators are rendered as calls, whose names need quotes."""
    return _LITERAL_OR_OPERATOR.sub(lambda m: m[1] or f"`{m[2]}`(", form._jc.node().sql())


def register(spark: SparkSession, lexicon: Lexicon | None = None) -> None:
    """Makes ``FORMS`` and ``PAIRS`` known to the session. With a lexicon also the views ``lexicon_names`` and
    ``lexicon_variants`` and the table function ``name_lookup(heard, kind)``, the entry with the heard name's norm, if any."""
    for name, kind, form in FORMS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(heard STRING) RETURNS {kind} RETURN {body(form(F.col('heard')))}")
    for name, function in PAIRS.items():
        spark.udf.register(name, function)
    if lexicon is None:
        return
    lexicon.names.createOrReplaceTempView("lexicon_names")
    lexicon.variants.createOrReplaceTempView("lexicon_variants")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION name_lookup(heard STRING, of STRING)
        RETURNS TABLE (id INT, name STRING, norm STRING, prob DOUBLE, rank_de INT)
        RETURN SELECT n.id, n.name, n.norm, n.prob, n.rank_de FROM lexicon_names n
          WHERE n.kind = name_lookup.of AND n.norm = name_norm(name_lookup.heard) AND n.norm <> ''""")
