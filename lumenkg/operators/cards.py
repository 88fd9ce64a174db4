"""Asset cards (theorems, formulas, examples) and the display pipeline of a lecture graph."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkg.functions.text import primary_name
from lumenkg.operators import kg as K

#: Kinds of cards.
KINDS = ("theorem", "principle", "technique", "formula", "example")


def card_errors(c: dict[str, Column]) -> Column:
    """What is wrong with a card of (name, kind, statement, steps, concepts), as an array of messages."""
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    checks = [
        ("name is empty", blank(c["name"])),
        ("unknown kind", ~F.coalesce(c["kind"], F.lit("")).isin(*KINDS)),
        ("statement is empty", blank(c["statement"]) & (c["kind"] != "technique")),
        ("a technique needs steps", (c["kind"] == "technique") & (F.size(c["steps"]) < 1)),
        ("no concept", F.size(c["concepts"]) < 1),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), message) for message, bad in checks]), lambda m: m.isNotNull())


# Words that tell a formula of the course from an example's, and operators that a formula has.
STORY = "小弟弟|红气球|抱住|苏格拉底|柏拉图|亚当|夏娃|终有一死|所有人都会死|所有人终有一死"
OFF_TOPIC = "牛顿|莱布尼茨|流数|微积分|导数积分|积分和式"
PROGRAM_POINT = "[ABCD]点(谓词)?|点谓词|程序点|循环不变"
GENERAL = "约定|记号|形式|规则|定理|公式|条件|充要|一般|任意|对所有|对任意|基本形式|易名|握手|完全图|补图|空图|量词|分离"
EXAMPLE_PREDICATE = r"(?i)\b(Embrace|LittleBrother|Balloon|Big|Red|Man|Likes|father|teacher)\s*\("
CAMEL_PREDICATE = r"\b[A-Z][a-z]+[A-Z][a-zA-Z]*\s*\("
OPERATORS = r"(=|\\sum|\\forall|\\exists|\\to|\\rightarrow|\\land)"

#: The ten reasons in order: each is (reason, what has to match, what must not), as (column, pattern) pairs, one of which suffices.
FORMULA_RULES = [
    ("off_topic", [("zh", OFF_TOPIC), ("summary", OFF_TOPIC)], []),
    ("program_point", [("zh", PROGRAM_POINT)], []),
    ("story", [("zh", STORY)], []),
    ("defined_value", [("zh", "定义为")], []),
    ("said_in_example", [("evidence", "^例如")], [("zh", GENERAL)]),
    ("example_predicate", [(c, p) for c in ("name", "latex") for p in (EXAMPLE_PREDICATE, CAMEL_PREDICATE)], [("zh", GENERAL)]),
    ("example_constants", [("zh", r"^个体常项\s*[a-zA-Z、, ]+$")], [("zh", GENERAL)]),
    ("operation", [("zh", "^(删去顶点|删去边|加边)")], []),
    ("bare_notation", [("zh", "记号")], [("latex", OPERATORS), ("zh", "个体|谓词|命题|量词")]),
    ("default_value", [("zh", r"权值.*设为\s*1|设为\s*1.*权值")], []),
]


def formula_drop_reason(name: Column, latex: Column, evidence: Column, summary: Column | None = None) -> Column:
    """Why a formula is no general one, by the first of FORMULA_RULES that fits, or null; names are read up to their slash."""
    text = lambda c: F.coalesce(c, F.lit(""))
    of = {"name": text(name), "latex": text(latex), "evidence": F.trim(text(evidence)), "summary": text(F.lit(None) if summary is None else summary), "zh": primary_name(text(name))}
    matches = lambda pairs: reduce(or_, [of[c].rlike(p) for c, p in pairs], F.lit(False))
    return F.coalesce(*[F.when(matches(some) & ~matches(none), reason) for reason, some, none in FORMULA_RULES])


#: Families of formulas that say one thing.
FAMILIES = [("handshake", "握手"), ("complete_edges", "完全图.*边数|边数.*完全图"), ("indiv_notation", "个体.*(字母|记号|常项|变项)|(字母|记号|常项|变项).*个体"), ("letter_pred", "谓词变项|命题与谓词")]


def generic_formulas(cards: DataFrame) -> DataFrame:
    """Cards (id, kind, name, latex, statement, ...) but formulas that formula_drop_reason drops; one formula of equal latex (white space aside), then one of a family: the richest, the first id if equal."""
    c = F.col
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("latex", F.lit("")), r"\s+", ""), r"\\,", "")
    family = F.coalesce(*[F.when(primary_name(c("name")).rlike(p), f) for f, p in FAMILIES])
    rows = cards.withColumn("_f", c("kind") == "formula").withColumn("_key", F.when(c("_f") & (plain != ""), plain)).withColumn("_family", F.when(c("_f"), family))
    rows = rows.filter(~c("_f") | formula_drop_reason(c("name"), c("latex"), c("evidence"), c("summary")).isNull())
    rich = [F.desc(c("name").contains("公式")), F.desc(F.length(F.coalesce("latex", F.lit("")))), F.desc(F.length(F.coalesce("statement", F.lit("")))), F.desc(F.length("name")), c("id")]
    for key in ("_key", "_family"):
        first = F.row_number().over(Window.partitionBy(F.coalesce(c(key), F.concat(F.lit("id "), c("id").cast("string")))).orderBy(*rich))
        rows = rows.withColumn("_i", first).filter("_i = 1").drop("_i")
    return rows.drop("_f", "_key", "_family")


def junk_theorem(name: Column, content: Column) -> Column:
    """A theorem without content, or whose name is a bare number or label."""
    return (F.length(F.trim(F.coalesce(content, F.lit("")))) < 4) | name.rlike(r"^(?i:theorem|lemma|定理|引理)?\s*[\d.\-]*$")


def align_properties(edges: DataFrame) -> DataFrame:
    """property_of edges point from the attribute to its owner and read "is a property of"; flagged ones are turned."""
    turn = (F.col("relation") == "property_of") & (F.col("direction") == "object_to_subject")
    out = edges.withColumn("_s", F.when(turn, F.col("object")).otherwise(F.col("subject"))).withColumn("object", F.when(turn, F.col("subject")).otherwise(F.col("object")))
    out = out.withColumn("subject", F.col("_s")).drop("_s")
    out = out.withColumn("direction", F.when(turn, "subject_to_object").otherwise(F.col("direction")))
    return out.withColumn("phrase", F.when(F.col("relation") == "property_of", "is a property of").otherwise(F.col("phrase")))


def awkward_delta(subject: Column, phrase: Column, object_: Column) -> Column:
    """A phrase that repeats an end, or a name that repeats the other one more than once."""
    times = lambda whole, part: (F.length(whole) - F.length(F.replace(whole, part, F.lit("")))) / F.greatest(F.length(part), F.lit(1))
    return phrase.contains(subject) | phrase.contains(object_) | (times(subject, object_) > 1) | (times(object_, subject) > 1)


def lcs_length(a: str, b: str, cap: int = 2000) -> int:
    """Length of the longest common substring of two texts, each of at most cap characters."""
    a, b = a[:cap], b[:cap]
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else 0), row[j]
            best = max(best, row[j])
    return best


def allowed_points(points: Column, allowed: Column) -> Column:
    """Knowledge points as named in the allowed list: equal but for white space and case, else one that holds the other."""
    key = lambda x: F.lower(F.regexp_replace(x, "\\s+", ""))
    exact = lambda p: F.filter(allowed, lambda a: key(a) == key(p))
    loose = lambda p: F.filter(allowed, lambda a: key(a).contains(key(p)) | key(p).contains(key(a)))
    found = F.transform(F.filter(points, lambda p: key(p) != ""), lambda p: F.coalesce(F.get(exact(p), F.lit(0)), F.get(loose(p), F.lit(0))))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def link_cards(grams: DataFrame, entities: DataFrame, k: int = 2, least: float = 0.1) -> DataFrame:
    """(card, entity, score): cards and entities, both (id, n, gram) rows, linked by shared grams; the k best entities of each card."""
    s = grams.select(F.col("id").alias("card"), F.col("n").alias("na"), "gram").join(entities.select(F.col("id").alias("entity"), F.col("n").alias("nb"), "gram"), "gram")
    s = s.groupBy("card", "entity", "na", "nb").agg(F.count("*").alias("c")).withColumn("score", F.col("c") / F.least("na", "nb")).filter(F.col("score") >= least)
    w = Window.partitionBy("card").orderBy(F.desc("score"), "entity")
    return s.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k).select("card", "entity", "score")


def display_graph(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """The lecture graph as shown: canonical names, no loops, one edge per triplet, no weak twins, one relation a pair, no shortcuts."""
    e = K.canonical(edges.select("subject", "relation", "object"), aliases, ["subject", "object"]).filter("subject <> object").distinct()
    return K.without_shortcuts(K.one_relation_per_pair(K.without_weak_twins(e))).select("subject", "relation", "object")


def prepared_tree_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hierarchy edges, related names per entity) for a tree: property edges and property-like names left out."""
    phrase = lambda c: F.col(c).rlike("(?i)( of | which |性质$|属性$)")
    e = edges.filter((F.col("relation") != "property_of") & ~phrase("subject") & ~phrase("object"))
    related = e.filter("relation = 'related_with'")
    both = related.select(F.col("subject").alias("entity"), F.col("object").alias("other")).unionByName(related.select(F.col("object").alias("entity"), F.col("subject").alias("other")))
    return e.filter(F.col("relation").isin("belong_to", "part_of")), both.groupBy("entity").agg(F.array_sort(F.collect_set("other")).alias("related"))
