"""Manifest, clusters and line dedup against plain reckonings of their contracts, with odd rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenkg.llm import clusters, linededup, merkle
from lumenkg.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, split int, pos int, doc string, th int, h1 long, path string, tree long, digest string, n int, block long, `odd.name` int"
EXTRA = (7, 7, 7, "d", 7, 7, "p", 7, "g", 7, 7, 7)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
low = lambda s: re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def documents(n=260):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lines = [rng.choice(["Hot LINE ", "  hot line", "warm \x0b", "x", "", " ", "É hot", "é hot", f"own {i}", f"own {i}", "K"]) for _ in range(rng.randrange(1, 12))]
        rows.append((i, "\n".join(lines), rng.choice(["en", "fr", None]), "hot" if i % 3 else f"s{i % 7}", i))
    rows += [(900, None, None, None, None), (None, "Null id\nhot line", "en", None, 1), (901, "", "en", "é", 0), (902, "\n\n", "en", "lone", 0), (903, "K \nK\nhot line", "en", "Z", 1)]
    rows += [(904, "Twice THE row\nhot line\nwarm", "en", "hot", 1)] * 3 + [(905, "one", "en", "hot", 1), (905, "two", "en", "hot", 1)]
    rows += [(906, "long LINE of a very long text\nhot line\n" * 30_000 + "end", "en", "hot", 2)]
    return [(*r, *EXTRA) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), DOCS).repartition(5).write.parquet(f"{at}/documents.parquet")
    return at


def plain_manifest(rows, arity=16):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def up(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
        return levels

    def walk(levels, p):
        out = []
        for level in levels[:-1]:
            a = p // arity * arity
            out.append((level[a:p], level[p + 1 : a + arity]))
            p //= arity
        return out

    trees = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        leaf = sha("".join(map(field, [doc_id, source, lang, n_chars, text])))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        used = sha("".join(map(field, [doc_id, source, lang, n_chars, low(text) if text is not None else None]))) if hit else leaf
        trees.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, used, doc_id))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: up([r[2] for r in sorted(trees[s])]) for s in names}
    tops = up([levels[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for p, (_, _, leaf, used, doc_id) in enumerate(sorted(trees[s])):
            path = walk(levels[s], p) + walk(tops, i)
            node = used
            for a, b in path:
                node = sha("".join([*a, node, *b]))
            out.append((doc_id, leaf, levels[s][-1][0], tops[-1][0], sha("".join(x for a, b in path for x in a + b)), node, node == tops[-1][0]))
    return out


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_manifest_query(spark, folder):
    got = rows_of(QUERIES["op11_merkle_manifest"](spark, folder), "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert got == sorted(plain_manifest(documents()), key=repr)


@pytest.mark.parametrize("arity,levels,n", [(2, 1, 45), (3, 2, 120), (2, 3, 260), (16, 1, 260)])
def test_manifest_of_many_levels(spark, arity, levels, n):
    rows = documents(n)[:n]
    rules = merkle.MerkleRules(arity=arity, block_levels=levels, broadcast_trees=0)
    out = merkle.manifest(spark, spark.createDataFrame(rows, DOCS).repartition(4), rules)
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(out.path).alias("proof"), merkle.folded(out.path, out.leaf).alias("folded"))
    want = sorted(((*r[:5], r[3]) for r in plain_manifest(rows, arity)), key=repr)
    assert rows_of(out, "doc_id", "leaf", "subroot", "root", "proof", "folded") == want


@pytest.mark.parametrize("arity,height", [(2, 5), (3, 3), (16, 2)])
def test_traversal_state_is_logarithmic(arity, height):
    leaves = [str(i) for i in range(arity**height - 1)]
    stack = merkle.Treehash(height, arity)
    for leaf in leaves:
        stack.push(leaf)
        assert sum(map(len, stack.runs)) < arity * height
    assert len(stack.close()) == 1
    assert len(list(merkle.traverse(leaves, height, arity))) == len(leaves)


def vectors():
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=64) * (3 if i % 3 else 0.1)]) for i in range(300)]
    rows += [(5, rows[5][1]), (7, [0.5] * 64), (None, rows[9][1]), (400, None), (401, [1.0] * 63), (402, [None] + [1.0] * 63), (403, [math.nan] + [1.0] * 63), (404, [math.inf] + [1.0] * 63), (405, [])]
    rows += [(i, rows[20][1]) for i in range(500, 560)]  # copies: ties, a large group
    return rows


def plain_clusters(rows):
    kept = [(i, [math.floor(1024 * int(x)) if abs(x) > 2**60 else math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((sha(f"3:{i}"), v) for i, v in kept if i is not None)[:8]
    cs = [v for _, v in starts]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(10):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cs)]
    out = [(i, *near(v)) for i, v in kept]
    per = Counter()
    for _, d, j in out:
        per[j] += d
    long = lambda x: x if x < 2**63 else None
    return sorted(((i, j, long(d), long(per[j]), long(sum(per.values())), sha(",".join(map(str, cs[j])))) for i, d, j in out), key=repr)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("more", [[], [(601, [3e7] * 64), (602, [-3.1e7] * 32 + [5.0] * 32)], [(600, [1e30] * 32 + [-2e-40] * 32), (603, [3.0e38] * 64)]], ids=["float64", "past 2^53", "past 2^63"])
def test_clusters(spark, tmp_path, more):
    rows = vectors() + more
    made = spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], "vec_id long, embedding array<float>, id int, v int, cluster string")
    made.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    held = [(r.vec_id, r.embedding) for r in made.collect()]  # as floats
    assert rows_of(QUERIES["op12_centroid_clusters"](spark, str(tmp_path)), *COLUMNS) == plain_clusters(held)


def test_few_vectors(spark, tmp_path):
    rows = [(1, [1.0] * 64), (2, [-1.0] * 64), (3, [1.0] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows_of(QUERIES["op12_centroid_clusters"](spark, str(tmp_path)), *COLUMNS) == plain_clusters(rows)


def test_bound_of_float64_is_exact():
    rules = clusters.ClusterRules()
    at = clusters.Centroids([[2**21] * 64, [-(2**21)] * 64], rules)
    assert rules.dim * (at.reach + at.top) ** 2 < clusters.EXACT
    x = np.array([[at.reach // 1024 - 1.0] * 64, [2.0**21] * 64])
    for rows, best, distance, ints in at.nearest(x):
        for r, j, d in zip(rows, best, distance):
            assert (d, j) == min((sum((int(1024 * v) - c) ** 2 for v, c in zip(x[r], cs)), k) for k, cs in enumerate(at.values))


def plain_lines(rows, min_docs=10):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    split = [(r[0], (r[1] or "").split("\n")) for r in rows]
    held = Counter(k for _, ls in split for k in {key(x) for x in ls})
    hot = {k for k, n in held.items() if k and n >= min_docs}
    return sorted(((i, len(ls), sum(key(x) in hot for x in ls), sha("\n".join(x for x in ls if key(x) not in hot))) for i, ls in split), key=repr)


def test_line_query(spark, folder):
    assert rows_of(QUERIES["op13_line_dedup"](spark, folder), "doc_id", "n_lines", "n_dropped", "kept_sha256") == plain_lines(documents())


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_first_occurrence_stays(spark, broadcast_rows):
    rows = [(3, "a\nb\nc", "s"), (1, "z\n a \na", "s"), (2, "b\na\nb", "s"), (None, "c", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    rules = linededup.LineRules(min_docs=2, keep_first=True, broadcast_rows=broadcast_rows)
    out = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(spark, docs, rules))
    assert {r.doc_id: r.kept for r in out.collect()} == {1: "z\n a ", 2: "b", 3: "", None: "c"}


def test_bitmap_is_run_lengths(spark):
    rows = [(i, "keep %d\nhot\nhot\nstay %d\nhot" % (i, i)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = linededup.keep_bitmaps(spark, docs).collect()
    assert len(marks) == 10 and all(m.runs == [1, 2, 1, 1] and m.n_dropped == 3 for m in marks)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op11_merkle_manifest", "op12_centroid_clusters", "op13_line_dedup"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == []
