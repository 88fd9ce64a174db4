"""Graph exports as rows of text, ready for a text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def graphml_edges(edges: DataFrame) -> DataFrame:
    s, o, r = (xml_escaped(F.col(c)) for c in ("subject", "object", "relation"))
    return edges.select(F.concat(F.lit('<edge source="'), s, F.lit('" target="'), o, F.lit('"><data key="relation">'), r, F.lit("</data></edge>")).alias("line"))


def cypher_statements(edges: DataFrame) -> DataFrame:
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    node = lambda v, c: F.concat(F.lit(f"MERGE ({v}:Entity {{name: "), quoted(c), F.lit("}) "))
    return edges.select(F.concat(node("a", "subject"), node("b", "object"), F.lit("MERGE (a)-[:"), F.upper("relation"), F.lit("]->(b);")).alias("statement"))
