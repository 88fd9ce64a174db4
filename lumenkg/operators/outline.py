"""The outline of a course: root, chapters, topics and what hangs below them, under budgets."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What parts a chapter's title, its number, and the chapter of what no other takes.
TITLE_NUMBER, TITLE_PARTS, OTHERS = r"^第\s*\d+\s*章\s*", r"[与和及、,，/\s]+", "__chapter__/其他要点"


@dataclass(frozen=True)
class Budgets:
    nodes: int = 120
    depth: int = 4
    children: int = 8
    chapter_nodes: int = 12
    #: Only so many entities of a course, the most important ones, may enter its outline: the bound of one call.
    pool: int = 160
    topics: int = 4
    leftovers: int = 12


def title_keys(chapter: str) -> list[str]:
    bare = re.sub(TITLE_NUMBER, "", chapter).strip()
    return list(dict.fromkeys([bare] * bool(bare) + [p for p in re.split(TITLE_PARTS, bare) if len(p) >= 2]))


def suits(name: str, keys: list[str]) -> bool:
    return any(k == name or (len(k) >= 2 and (k in name or name in k)) for k in keys)


class Outline:
    """Parents chosen so far, each with its depth and its number of children."""

    def __init__(self, root: str, budgets: Budgets):
        self.b, self.rows, self.depth, self.kids = budgets, [], {root: 0}, {}

    def full(self) -> bool:
        return len(self.depth) >= self.b.nodes

    def add(self, node: str, parent: str, relation: str) -> None:
        self.rows.append((node, parent, relation, self.depth[parent] + 1))
        self.depth[node] = self.depth[parent] + 1
        self.kids[parent] = self.kids.get(parent, 0) + 1


def outline(root: str, importance: dict[str, float], edges: list[tuple[float, str, str, str]], chapters: list[str], budgets: Budgets = Budgets()) -> list[tuple[str, str, str, int]]:
    """(node, parent, relation, depth) of one course.

    importance: the pool; edges (strength, parent, child, relation) inside it.  A chapter takes its topics, entities that its
    title names or, with fewer than two of them, their neighbours; then, strongest edges first, children of what it has,
    until its own, the depth's, the parent's or the whole budget is used up.  The most important of the rest share one more chapter.
    """
    out = Outline(root, budgets)
    zh = {n: n.split("/")[0].strip() for n in importance}
    best = sorted(importance, key=lambda n: (-importance[n], n))
    for chapter in chapters:
        if out.full():
            break
        at, keys = f"__chapter__/{re.sub(TITLE_NUMBER, '', chapter).strip() or chapter}", title_keys(chapter)
        if at in out.depth:
            continue
        out.add(at, root, "toc_chapter")
        named = [n for n in best if suits(zh[n], keys)]
        free = [n for n in named if n not in out.depth]
        topics = free[: budgets.topics]
        if len(topics) < 2:
            about = set(free[:6]) or set(named)
            near = {c for _, p, c, _ in edges if p in about} | {p for _, p, c, _ in edges if c in about}
            topics += [n for n in best if n in near and n not in out.depth and n not in topics][: budgets.topics - len(topics)]
        local = {at}
        for n in topics:
            if out.full() or len(local) >= budgets.chapter_nodes:
                break
            out.add(n, at, "chapter_topic")
            local.add(n)
        ranked = sorted((e for e in edges if e[1] in local or e[2] in local), key=lambda e: (-e[0], -importance[e[2]], e[1:]))
        grew = True
        while grew:
            grew = False
            for _, parent, child, relation in ranked:
                if out.full() or len(local) >= budgets.chapter_nodes:
                    break
                if parent in local and child not in out.depth and out.depth[parent] + 1 < budgets.depth and out.kids.get(parent, 0) < budgets.children:
                    out.add(child, parent, relation)
                    local.add(child)
                    grew = True
    rest = [n for n in best if n not in out.depth][: budgets.leftovers]
    if rest and not out.full():
        out.add(OTHERS, root, "toc_chapter")
        for n in rest[: budgets.children]:
            if not out.full():
                out.add(n, OTHERS, "attach")
    return out.rows


def course_outlines(entities: DataFrame, edges: DataFrame, chapters: DataFrame, budgets: Budgets = Budgets()) -> DataFrame:
    """(course, node, parent, relation, depth) of every course at once.

    entities (course, node, importance), edges (course, parent, child, relation, strength), chapters (course, chapter, place).
    Spark cuts each course to its pool and to the edges inside it (a task keeps the best of its own rows
    before the shuffle), and to as many chapters as there are nodes, so a call holds a bounded group however large the course.
    """
    top = Window.partitionBy("course").orderBy(F.desc("importance"), "node")
    pool = entities.withColumn("_i", F.row_number().over(top)).filter(F.col("_i") <= budgets.pool).drop("_i")
    end = lambda name: pool.select("course", F.col("node").alias(name))
    inside = edges.join(end("parent"), ["course", "parent"], "left_semi").join(end("child"), ["course", "child"], "left_semi").filter("parent <> child")
    inside = inside.groupBy("course", "parent", "child", "relation").agg(F.max("strength").alias("strength"))
    first = Window.partitionBy("course").orderBy("place", "chapter")
    named = chapters.withColumn("_i", F.row_number().over(first)).filter(F.col("_i") <= budgets.nodes)
    none = lambda t: F.lit(None).cast(t)
    rows = pool.select("course", F.lit("entity").alias("kind"), F.col("node").alias("a"), none("string").alias("b"), none("string").alias("r"), F.col("importance").cast("double").alias("x"))
    rows = rows.unionByName(inside.select("course", F.lit("edge").alias("kind"), F.col("parent").alias("a"), F.col("child").alias("b"), F.col("relation").alias("r"), F.col("strength").cast("double").alias("x")))
    rows = rows.unionByName(named.select("course", F.lit("chapter").alias("kind"), F.col("chapter").alias("a"), none("string").alias("b"), none("string").alias("r"), F.col("_i").cast("double").alias("x")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        course, kinds = group["course"].iloc[0], dict(tuple(group.groupby("kind")))
        of = lambda kind: kinds[kind] if kind in kinds else group.iloc[:0]
        importance = dict(zip(of("entity")["a"], of("entity")["x"]))
        links = list(zip(*(of("edge")[c] for c in "xabr")))
        titles = of("chapter").sort_values("x")["a"].tolist()
        made = outline(f"__course__/{course}", importance, links, titles, budgets)
        return pd.DataFrame([(course, *r) for r in made], columns=["course", "node", "parent", "relation", "depth"])

    kind = entities.schema["course"].dataType.simpleString()
    return rows.groupBy("course").applyInPandas(run, f"course {kind}, node string, parent string, relation string, depth int")
