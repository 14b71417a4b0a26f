"""Every operator against its brute-force twin on small hostile tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import (
    hyper_langid,
    importance_resampling,
    kneser_ney,
    label_sharding,
    line_dedup,
    metric_range_join,
    minhash_dedup,
    piece_bpe,
    quality_rules,
    source_mixing,
    wordhash,
)
from lectern.llm.models import PIECE_MODEL

from .helpers import DOC_SCHEMA, components, corpus, prose, words


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns whose names clash with what operators use inside
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("row", "size", "shard", "line", "id", "family", "kept", "h", "v", "n")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def shingle_set(text):
    w = words(text, lower=True)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(docs, rows, empty):
    got = minhash_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    links = []
    for i, a in enumerate(ids):
        for j in range(i):
            p, q = sets[a], sets[ids[j]]
            if p and q and 100 * len(p & q) >= 85 * len(p | q):
                links.append((j, i))
    comp = {i: ids[c] for i, c in zip(ids, components(len(ids), links), strict=True)}
    assert len(links) >= 6
    for r in got:
        assert r.component_id == comp.get(r.doc_id) and r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles == len(sets[r.doc_id])
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_one_large_family(spark):
    """Chains and tiles: blocks smaller than the family must not lose links."""
    rng = random.Random(3)
    base = [f"x{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = f"y{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    old = minhash_dedup.BLOCK_ROWS
    minhash_dedup.BLOCK_ROWS = 16
    try:
        got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        minhash_dedup.BLOCK_ROWS = old
    again = minhash_dedup.near_duplicates(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in again} == got
    sets = [shingle_set(t) for _, t in rows]
    links = [(j, i) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert [got[i] for i in range(150)] == components(150, links)


def test_rows_of_a_large_group_follow_its_size(spark):
    """A group that hangs together needs a row per member and the representatives, no tiles of all blocks."""
    old = minhash_dedup.BLOCK_ROWS
    for n in (2_000, 8_000):
        blocks = n // 100
        placed = spark.range(n).select(F.lit(1).alias("family"), "id", F.lit(blocks).alias("blocks"))
        first = minhash_dedup._beside_representatives(placed, "family")
        assert first.count() == n + blocks * minhash_dedup.REPRESENTATIVES
        assert first.groupBy("family", "i", "j").count().agg(F.max("count")).first()[0] < 200
        together = placed.select("id", F.lit(0).cast("long").alias("component"))
        assert minhash_dedup._rest_beside_all(placed, "family", together) is None
        apart = placed.select("id", F.when(F.col("id") % 1000 == 7, F.col("id")).otherwise(0).alias("component"))
        rest = minhash_dedup._rest_beside_all(placed, "family", apart)
        pairs = rest.where("component <> 0").select("family", "i", "j", F.col("id").alias("x")).join(rest, ["family", "i", "j"]).select("x", "id").distinct()
        assert pairs.count() == n // 1000 * n  # every member left apart meets every member
    assert minhash_dedup.BLOCK_ROWS == old


def test_the_row_that_stays_does_not_depend_on_order(spark):
    rows = [(1, f"text {i} of one document", "aa", "s", i) for i in range(20)] + [(2, None, None, None, None)] * 3
    pick = lambda r: sorted(map(repr, minhash_dedup.deduplicated(spark.createDataFrame(r, DOC_SCHEMA).repartition(3)).collect()))
    assert pick(rows) == pick(rows[::-1]) and len(pick(rows)) == 2


def test_one_row_per_component(docs, rows):
    left = minhash_dedup.deduplicated(docs)
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    kept = {r.doc_id for r in minhash_dedup.near_duplicates(docs).where("kept").collect()}
    assert sorted(i for i in ids if i is not None) == sorted(i for i in kept if i is not None)
    assert left.columns == docs.columns and None in ids


def test_importance_resampling(spark, empty):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(40, 120), 200) if i % 5 else " ".join(f"JUNK{rng.randrange(50)}!" for _ in range(80)), "aa", "s", 0) for i in range(300)]
    rows += [(1000, None, "aa", "s", 0), (1001, "", "aa", "s", 0), (None, prose(rng, 50, 200), None, None, None)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 300, 2)] + [(5000, 1, 0), (None, 1, None), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in importance_resampling.resample(docs, labels).collect()}
    assert len(got) == len(rows)
    wrong = [i for i in range(300) if got[i].kept != (i % 5 != 0)]
    assert len(wrong) <= 6
    assert got[1000].log_weight == got[1001].log_weight == 0
    assert sum(r.kept for r in got.values()) == sum(1 for _ in importance_resampling.selected(docs, labels).collect())
    # without labels nothing can be told apart
    assert importance_resampling.resample(docs, labels.limit(0)).where("not kept").count() == 0
    assert importance_resampling.resample(empty, labels).count() == 0


def test_resampling_by_a_plain_loop(spark, rows):
    """Models, correlation, weights, noise, cut and sample worked out document by document."""
    import xxhash

    rng = random.Random(12)
    table = [r for r in rows if r[0] is not None] + [(600 + i, prose(rng, 30 + i, 90).replace("w", "j"), "aa", "s", 0) for i in range(40)]
    table += [table[4], table[4], (None, prose(rng, 40), "aa", "s", 0)]
    marks = {i: (1, 0) for i in range(40)} | {600 + i: (0, 0) for i in range(40)} | {3: (1, 1), 300: (1, 0)}
    # columns named like those inside pass by
    docs = spark.createDataFrame(table, DOC_SCHEMA).selectExpr("*", "1 as h", "2 as n", "3 as log_weight", "4 as quality", "'x' as toxic")
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in marks.items()] + [(5, 0, 0)], "doc_id long, quality int, toxic int")
    marks[5] = (0, 0)
    seed, size = 11, importance_resampling.BUCKETS
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def xx(*parts):
        out = 42
        for p in parts:
            if p is not None:
                data = p.encode() if isinstance(p, str) else (p[0] & 0xFFFFFFFF).to_bytes(4, "little") if isinstance(p, tuple) else (p & (1 << 64) - 1).to_bytes(8, "little")
                out = xxhash.xxh64_intdigest(data, out)
        return signed(out)

    def grams(text):
        out = Counter()
        for _, offsets, hashes in wordhash.words_of([text]):
            own = hashes.tolist()
            assert len(own) == len(words(text)) == offsets[1]
            out.update(h % size for h in own)
            for a, b in zip(hashes[:-1], hashes[1:], strict=True):
                out[int(wordhash.shingle_ids(np.array([a, b]), 2)[0]) % size] += 1
        return out

    every = [(i, t, grams(t)) for i, t, *_ in table]
    held = lambda i: xx(i, (seed + 1,)) % 3 == 0
    fit = [g for i, _, g in every if i in marks and marks[i] == (1, 0) and not held(i)]
    target, raw = sum(fit, Counter()), sum((g for _, _, g in every), Counter())
    tn, rn = sum(target.values()), sum(raw.values()) + size

    def ratio(b):
        base = (raw[b] + 1) / rn
        return math.log((target[b] + importance_resampling.SHRINK * tn * base) / (tn * (1 + importance_resampling.SHRINK))) - math.log(base)

    lists = [[ratio(b) for b, c in g.items() for _ in range(c)] for g in fit if g]
    n = [len(x) for x in lists]
    mean = sum(map(sum, lists)) / sum(n)
    among = sum(len(x) * (sum(x) / len(x) - mean) ** 2 for x in lists) / (len(n) - 1)
    within = sum((y - sum(x) / len(x)) ** 2 for x in lists for y in x) / (sum(n) - len(n))
    typical = (sum(n) - sum(x * x for x in n) / sum(n)) / (len(n) - 1)
    r = max(0.0, (among - within) / (among + (typical - 1) * within))
    assert r > 0
    weight = []
    for i, t, g in every:
        total, k = sum(c * ratio(b) for b, c in g.items()), sum(g.values())
        u = ((xx(i, xx(t), (seed,)) & (1 << 64) - 1) >> 11) + 0.5
        weight.append((i, total, total / (1 + max(0, k - 1) * r), -math.log(-math.log(u / (1 << 53)))))
    cut = importance_resampling.best_cut(*(np.array([w for i, _, w, _ in weight if i in marks and held(i) and (marks[i][0] == 1) == good]) for good in (True, False)))
    k = sum(w >= cut for _, _, w, _ in weight)
    limit = sorted((w + z for _, _, w, z in weight), reverse=True)[k - 1]
    want = sorted(((-1 if i is None else i), round(s, 6), round(w, 6), round(w + z, 6), w + z >= limit) for i, s, w, z in weight)
    got = importance_resampling.resample(docs, labels, seed=seed).collect()
    have = sorted((-1 if r.doc_id is None else r.doc_id, round(r.log_ratio, 6), round(r.log_weight, 6), round(r.gumbel_key, 6), r.kept) for r in got)
    assert len(have) == len(want) and 0 < k < len(want)
    for x, y in zip(have, want, strict=True):
        assert x[0] == y[0] and x[1:4] == pytest.approx(y[1:4], abs=1e-5) and x[4] == y[4]


def test_gumbel_top_k_is_exact(spark):
    values = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(997)) / 10.0).alias("x"))
    want = sorted((r.x for r in values.collect()), reverse=True)
    for k in (1, 17, 2500, 5000):
        assert importance_resampling.kth_largest(values, "x", k) == want[k - 1]
    assert importance_resampling.kth_largest(values, "x", 0) == math.inf


def test_shards(docs, rows, empty):
    got = label_sharding.balanced_shards(docs).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert label_sharding.balanced_shards(empty).count() == 0


def test_shards_keep_groups_together(spark):
    rows = [(i, f"text {i // 3 if i < 900 else i}") for i in range(2000)] + [(5000 + i, "hot") for i in range(1000)]
    got = label_sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(counts) == 24
    threes = got[got.doc_id < 900].groupby("text_crc32").shard.nunique()
    assert (threes == 1).mean() > 0.85  # at random it would be under 1 percent
    links, cut = label_sharding.cut_links(spark.createDataFrame(got[["text_crc32", "shard"]])).first()
    hot = got[got.doc_id >= 5000].groupby("shard").size().sort_values(ascending=False)
    by_text = got.groupby("text_crc32").shard.agg(["size", "nunique"])
    assert (links, cut) == ((by_text["size"] - 1).sum(), (by_text["nunique"] - 1).sum()) == (600 + 999, cut)
    # a text of 8 shards' size: nine shards hold most of it, dealt by hash it would be three eighths
    assert hot.iloc[:9].sum() >= 800
    rng = random.Random(2)
    dealt = [(c, rng.randrange(24)) for c in got.text_crc32.tolist()]
    by_chance = label_sharding.cut_links(spark.createDataFrame(dealt, "text_crc32 long, shard int")).first().cut
    assert cut < 0.25 * by_chance


def test_shards_of_one_text_lie_together_beyond_a_bucket(spark, monkeypatch):
    """The parts in which a large group is laid out do not scatter it."""
    rows = [(i, f"t{i}") for i in range(3000)] + [(9000 + i, f"copy {i % 2}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for bucket in (2000, 20):
        monkeypatch.setattr(label_sharding, "BUCKET_ROWS", bucket)
        got = label_sharding.balanced_shards(docs, shards=8).toPandas()
        assert got.groupby("shard").size().tolist() == [400] * 8 and got.groupby("shard").slot.nunique().tolist() == [400] * 8
        found.append(got[got.doc_id >= 9000].groupby("text_crc32").shard.nunique().max())
    assert max(found) <= 2


def test_propagation_by_a_plain_loop(spark):
    """Rounds of majority moves under quotas: the labels settle where a loop over all groups puts them."""
    rows = [(i, f"t{i % 40}") for i in range(400)]
    nodes = label_sharding.nodes_of(spark.createDataFrame(rows, "doc_id long, text string"))
    start = {r.row: r.label for r in label_sharding.propagate(nodes, 4, 0, 0.1).collect()}
    before = {r.row: (r.grp, r.label) for r in label_sharding.propagate(nodes, 4, 0, 0.1).collect()}
    after = {r.row: (r.grp, r.label) for r in label_sharding.propagate(nodes, 4, 1, 50.0).collect()}
    assert {k: v[1] for k, v in before.items()} == start
    votes = defaultdict(Counter)
    for grp, label in before.values():
        votes[grp][label] += 1
    # with room for all, every group ends on a label that most of its members carried
    labels = defaultdict(set)
    for grp, label in after.values():
        labels[grp].add(label)
    assert all(len(v) == 1 and votes[g][next(iter(v))] == max(votes[g].values()) for g, v in labels.items())
    # without any room, only swaps: sizes stay near what they were
    tight = label_sharding.propagate(nodes, 4, 3, -1.0).groupBy("label").count().collect()
    sizes = Counter(v for _, v in before.values())
    assert all(abs(r["count"] - sizes[r.label]) <= 60 for r in tight)


def test_line_dedup(docs, rows, empty, spark):
    sites = defaultdict(set)
    first: dict[str, int | None] = {}
    norm = lambda line: " ".join(words(line.lower()))
    extra = [(400 + i, f"own words of number {i} here\nThis  line is on every Site\nshort one\n", "aa", f"t{i % 7}", 0) for i in range(30)]
    table = rows + extra
    for doc_id, text, _, source, _ in table:
        for line in (text or "").split("\n"):
            if words(line):
                sites[norm(line)].add(source)
                old = first.get(norm(line), doc_id)
                first[norm(line)] = doc_id if old is None else old if doc_id is None else min(old, doc_id)
    common = {x for x, s in sites.items() if len(s) >= 5}
    assert common == {"this line is on every site", "short one"}
    df = spark.createDataFrame(table, DOC_SCHEMA)
    got = line_dedup.remove_boilerplate(df).select("doc_id", "text", "n_lines", "n_removed").collect()
    old = line_dedup.FEW_LINES
    line_dedup.FEW_LINES = 0  # the way of lines too many to broadcast
    try:
        again = line_dedup.remove_boilerplate(df).select("doc_id", "text", "n_lines", "n_removed").collect()
    finally:
        line_dedup.FEW_LINES = old
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    want = []
    for doc_id, text, *_ in table:
        lines = text.split("\n") if text else []
        left = [x for x in lines if norm(x) not in common or first[norm(x)] == doc_id]
        want.append((doc_id, text if len(left) == len(lines) else "\n".join(left), len(lines), len(lines) - len(left)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert line_dedup.remove_boilerplate(docs).count() == len(rows)
    assert line_dedup.remove_boilerplate(empty).count() == 0


CLASHING = ("_id", "_h", "_kept", "_gone", "gone", "gone_id", "left_over", "n_lines", "n_removed", "copy", "_copy", "Shard", "place", "m", "id", "h")


def test_columns_of_any_name_pass_through(spark):
    """What the operators that hand rows on use inside must not touch a caller's columns."""
    line = "all rights reserved"
    rows = [(i, f"{line}\n" + " ".join(f"v{i}x{k}" for k in range(60)), "aa", f"s{i % 8}", 300) for i in range(24)]
    rows += [(100, rows[0][1], "aa", "s0", 300), (101, rows[1][1], "bb", "s1", 300)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in CLASHING])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(24)], "doc_id long, quality int, toxic int")
    for out in (
        line_dedup.without_boilerplate(docs), minhash_dedup.deduplicated(docs),
        importance_resampling.selected(docs, labels), source_mixing.mixed_documents(docs),
    ):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHING)


def test_emptied_documents_go(spark):
    line = "the very same line of words"
    rows = [(i, line, "aa", f"s{i}", len(line)) for i in range(6)] + [(9, "", "aa", "s9", 0), (10, None, "aa", "s9", None)]
    out = line_dedup.without_boilerplate(spark.createDataFrame(rows, DOC_SCHEMA)).collect()
    assert sorted(r.doc_id for r in out) == [0, 9, 10]


def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    near = base[:20] + rng.normal(size=(20, 8)) * 0.05
    rows = [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(np.concatenate((base, near, base[:5], base[:5] * 3)))]
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] + [1.0] * 7, 1), (203, [None] + [1.0] * 7, 1), (204, [], 1), (205, [float("inf")] * 8, 1)]
    return rows + [(None, rows[0][1], 1), (206, [1.0, 2.0], None), (207, [2.0, 4.0], None)]


@pytest.mark.parametrize("block,cell", [(20_000, 5000), (7, 10)])
def test_near_vectors(spark, block, cell):
    rows = vectors() + [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [0.02, 1.0], 0), (3, [0.01, 1.0], 0)]
    old = metric_range_join.BLOCK_ROWS, metric_range_join.CELL_ROWS
    metric_range_join.BLOCK_ROWS, metric_range_join.CELL_ROWS = block, cell
    try:
        # columns named like those inside pass by
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as n", "3 as v", "4 as home", "5 as cell")
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in metric_range_join.near_vectors(table).collect()), key=repr)
    finally:
        metric_range_join.BLOCK_ROWS, metric_range_join.CELL_ROWS = old
    unit = []
    for i, v, _ in rows:
        good = i is not None and v and None not in v and np.isfinite(v).all() and any(v)
        x = np.array(v, dtype=np.float64) if good else None
        unit.append(x / np.linalg.norm(x) if good else None)
    k = range(len(rows))
    links = [(a, b) for a in k for b in k if a < b and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    n = Counter(x for e in links for x in e)
    comp = components(len(rows), links)
    least = {c: min(rows[i][0] for i in k if comp[i] == c and rows[i][0] is not None) for c in comp if rows[c][0] is not None}
    want = [(rows[i][0], n[i], least.get(comp[i]), rows[i][0] is None or least[comp[i]] == rows[i][0]) for i in k]
    assert got == sorted(want, key=repr)
    assert metric_range_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_profiles(spark, sf, docs, rows, empty):
    got = hyper_langid.identify(spark.read.parquet(f"{sf}/documents.parquet"))
    joined = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(joined) > 30 and sum(r.lang == r.lang_pred for r in joined) >= 0.9 * len(joined)
    by_row = hyper_langid.identify(docs).collect()
    assert len(by_row) == len(rows)
    by = {r.doc_id: r for r in by_row}
    for i in (300, 301, 302):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in by_row)
    assert hyper_langid.identify(empty).count() == 0


def plain_trigrams(text):
    out, word = Counter(), ""
    for c in text.replace("\u03a3", "\u03c3").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            out.update(f" {word} "[i : i + 3] for i in range(len(word)))
            word = ""
    return out


def test_trigrams_of_pieces(monkeypatch):
    rng = random.Random(6)
    texts = ["", " ", "a", "\u039f\u0394\u03a5\u03a3\u03a3\u0395\u03a5\u03a3 \u0130x", *["".join(rng.choice("abC  1.\u03a3\u03c2\u65e5") for _ in range(n)) for n in range(1, 60)]]
    for piece in (1, 2, 3, 7, 1 << 18):
        monkeypatch.setattr(hyper_langid, "PIECE", piece)
        for text in texts:
            grams, counts = hyper_langid.trigrams(text)
            got = {"".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0)): c for g, c in zip(grams.tolist(), counts.tolist(), strict=True)}
            assert got == plain_trigrams(text), (piece, text)


def test_predictions_by_a_plain_loop(spark, rows):
    """Sums, prototypes and cosines worked out word by word give the same languages and scores."""
    more = [(500 + i, t, lang, "s", 0) for i, (t, lang) in enumerate([("tie tie", "bb"), ("tie tie", "aa"), ("xyz", "cc"), ("xyz", "aa"), (None, "dd"), ("12 34", "dd")] * 2)]
    table = rows + more
    got = sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in hyper_langid.identify(spark.createDataFrame(table, DOC_SCHEMA)).collect()), key=repr)
    space = hyper_langid._Space()

    def profile(text):
        v = np.zeros(hyper_langid.DIM)
        for g, c in plain_trigrams(text or "").items():
            a, b, z = (space.letter(ord(x)).astype(float) for x in g)
            v += c * np.roll(a, 2) * np.roll(b, 1) * z
        return v

    sums = {}
    for i, text, lang, *_ in table:
        if lang is not None and plain_trigrams(text or "") and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2):
            sums[lang] = sums.get(lang, 0) + profile(text)
    want = []
    for i, text, *_ in table:
        v = profile(text)
        if not v.any():
            want.append((i, "und", 0.0))
            continue
        cos = {x: float(v @ p) / (np.linalg.norm(v) * np.linalg.norm(p)) for x, p in sums.items()}
        best = min(cos, key=lambda x: (-cos[x], x))
        want.append((i, best, round(min(1.0, max(0.0, cos[best])), 9)))
    assert [(i, p, pytest.approx(s, abs=1e-8)) for i, p, s in sorted(want, key=repr)] == got


def test_bundle_is_the_sum_of_bound_vectors():
    grams, counts = hyper_langid.trigrams("Ab, ab")
    space = hyper_langid._Space()
    letter = lambda c: space.letter(ord(c)).astype(int)
    want = np.zeros(hyper_langid.DIM, dtype=int)
    for word in (" ab ", " ab "):
        for i in range(len(word) - 2):
            a, b, c = word[i : i + 3]
            want += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    assert (space.bundle(grams, counts) == want).all()


def test_mix(docs, rows, empty, spark, sf):
    got = source_mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, len(words(t))) for i, t, *_ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    again = source_mixing.mix_report(docs.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert source_mixing.mix_report(empty).count() == 0
    table = spark.read.parquet(f"{sf}/documents.parquet")
    out = source_mixing.mix_report(table).join(table.select("doc_id", "source"), "doc_id").toPandas()
    sums = out.groupby("source").agg(size=("size", "sum"), stated=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sums["size"] == sums.stated).all() and abs(sums.target.sum() - sums["size"].sum()) < 1e-6
    assert (sums.target <= 3 * sums["size"] + 1e-6).all() and (abs(sums.taken - sums.target) <= 0.1 * sums.target).all()
    copies = source_mixing.mixed_documents(table)
    assert copies.columns == table.columns
    times = Counter(r.doc_id for r in copies.select("doc_id").collect())
    assert all(times[r.doc_id] * r.size == r.taken for r in out.itertuples())


def test_mix_by_a_plain_loop(spark):
    """Whole passes, a prefix in the hashed order, and single documents that close the gap, source by source."""
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randrange(1, 30)), "aa", rng.choice(["a", "b", "b", "c", "c", "c", "c", None]), 0) for i in range(160)]
    rows += [(200 + i, prose(rng, 3), "aa", "tiny", 0) for i in range(2)] + [rows[5], (300, None, "aa", "a", 0), (301, "", "aa", "c", 0)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    got = source_mixing.mix_report(docs).collect()
    size = defaultdict(int)
    for _, text, _, source, _ in rows:
        size[source] += len(words(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal, free, rest = {}, set(order), float(sum(size.values()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while True:
        unit = rest / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 3 * size[s]}
        if not over:
            break
        goal |= {s: 3.0 * size[s] for s in over}
        free -= over
        rest = sum(size.values()) - sum(goal.values())
    goal |= {s: unit * weight[s] for s in free}
    source = {r[0]: r[3] for r in rows}
    times = {(r.doc_id, r.size): r.taken // r.size for r in got if r.size}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r.source_size, r.target) == (size[s], pytest.approx(goal[s])) and (not r.size or r.taken % r.size == 0)
        passes = min(3, int(goal[s] // size[s])) if size[s] else 0
        if r.size:  # every document is in all whole passes, and at most once or twice more
            assert passes <= times[r.doc_id, r.size] <= min(3, passes + 2)
        taken[s] += r.taken
    for s in order:  # what is left of the target is less than the smallest document that could still have been taken
        could = [len(words(t)) for i, t, _, o, _ in rows if o == s and words(t) and times[i, len(words(t))] < 3]
        assert abs(taken[s] - goal[s]) <= max(0.002 * goal[s], min(could, default=0)) + 1e-6


def test_any_number_of_sources(spark, monkeypatch):
    """Beyond what the driver holds, targets and plans are the same and shards as even."""
    rng = random.Random(22)
    rows = [(i, prose(rng, rng.randrange(1, 9)), "aa", rng.choice([f"s{k}" for k in range(60)] + [None]), 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    one = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in source_mixing.mix_report(docs).collect())
    monkeypatch.setattr(source_mixing, "MAX_SOURCES", 7)
    monkeypatch.setattr(source_mixing, "SOURCE_GROUPS", 5)
    many = source_mixing.mix_report(docs).collect()
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in many) == one
    counts = Counter(s for r in many for s in r.shards)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, words long")
    want = source_mixing.targets([("a", 10), ("b", 1000), ("c", 1000), (None, 0)])
    assert {r.source: r.target for r in source_mixing.targets_table(sizes).collect()} == {k: pytest.approx(v) for k, v in want.items()}


def test_targets_are_water_filled():
    assert source_mixing.targets([("a", 10), ("b", 1000), ("c", 1000)]) == {"a": 30.0, "b": pytest.approx(1980 * 2 / 3), "c": pytest.approx(1980 / 3)}
    assert source_mixing.targets([(None, 100), ("z", 100)]) == {"z": pytest.approx(1000 / 7), None: pytest.approx(400 / 7)}
    assert source_mixing.targets([("a", 0), ("b", 0)]) == {"a": 0.0, "b": 0.0}


def test_splitting_tree_is_exact():
    tree = source_mixing.split_quotas([100, 3, 0, 57], 7, 1)
    assert tree.sum(axis=0).tolist() == [100, 3, 0, 57] and (tree >= 0).all()
    assert tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 1


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def test_pieces_equal_the_library(docs, rows, empty, library):
    got = piece_bpe.encode_documents(docs, PIECE_MODEL, ("ids", "decoded")).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or ""), 2]
        back = library.decode(ids)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(back), ids, back))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert piece_bpe.encode_documents(empty, PIECE_MODEL).count() == 0


def test_pieces_of_random_text(library):
    rng = random.Random(9)
    model = piece_bpe.PieceModel(open(PIECE_MODEL, "rb").read())
    letters = "abcdeéñß日😀▁ \t\n.,=-_(){}0123ABC"
    for n in (1, 5, 30, 400):
        for _ in range(300):
            text = "".join(rng.choice(letters) for _ in range(n))
            ids = [*library.encode(text), 2]
            assert model.encode(text)[:2] == (" ".join(map(str, ids)), len(ids)) and model.encode(text)[2] == library.decode(ids)


def test_kneser_ney(docs, rows, empty):
    got = kneser_ney.score_documents(docs).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*words(t, lower=True), "</s>"]) for i, t, *_ in rows]
    c, b = Counter(), Counter()
    for i, t in tokens:
        if not held(i):
            c.update(t)
            b.update(zip(["<s>", *t], t, strict=False))
    n, v, cont = sum(c.values()), len(c), Counter(w for _, w in b)
    ctx, kinds = Counter(), defaultdict(Counter)
    for (h, _), k in b.items():
        ctx[h] += k
        kinds[h][min(k, 3)] += 1
    tally = lambda x: [sum(y == k for y in x.values()) for k in (1, 2, 3, 4)]
    db, dw = kneser_ney.discounts(tally(b)), kneser_ney.discounts(tally(cont))
    floor = sum(dw[min(k, 3)] for k in cont.values()) / len(b) / (v + 1)

    def p(h, w):
        low = max(cont[w] - dw[min(cont[w], 3)], 0) / len(b) + floor
        if not ctx[h]:
            return low
        k = b[h, w]
        return (max(k - db[min(k, 3)], 0) + sum(db[j] * x for j, x in kinds[h].items()) * low) / ctx[h]

    assert sum(p("w1", w) for w in c) + p("w1", "unseen") == pytest.approx(1)
    want = sorted(
        (i if i is not None else -1, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6), round(sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t], t, strict=False)), 6))
        for i, t in tokens
    )
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    for x, y in zip(have, want, strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], abs=1e-4)
    assert kneser_ney.score_documents(empty).count() == 0


@pytest.mark.parametrize("name", ["op1_minhash_dedup", "op4_line_dedup", "op5_metric_range_join", "op10_quality_rules"])
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    from lectern.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, rel = queries.queries()[name](spark, sf), con.sql(queries.oracle_sql()[name])
    columns = sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert sorted(df.columns) == columns and got == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall()) and got


def test_quality_rules(docs, rows, empty, spark):
    def base(text):
        w = words(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)

    more = [(500, "a b c a b c a b c", None, None, 0), (501, "x x x x x", None, "s0", 0), (502, "a|b <c>\nq\nq\n \nq #$", None, "s0", 0)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows + more, DOC_SCHEMA)).collect()
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == sorted((i if i is not None else -1, *base(t)) for i, t, *_ in rows + more)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept) for r in got)
    # a line on most pages of one host takes most of the words of some
    boiler = " ".join(f"b{i}" for i in range(60))
    rng = random.Random(4)
    site = [(i, boiler + "\n" + prose(rng, 55 if i % 2 else 200, 4000), "aa", "h", 0) for i in range(40)]
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(site, DOC_SCHEMA)).collect()}
    assert all(out[i] == (i % 2 == 0) for i in range(40))
    assert quality_rules.quality_rules(docs).count() == len(rows) and quality_rules.quality_rules(empty).count() == 0


@pytest.mark.parametrize("few,longest", [(1_000_000, 4_000), (0, 4_000), (1_000_000, 1)])
def test_quality_rules_takes_lines_out(spark, monkeypatch, few, longest):
    """The text that is left, against a loop; broadcast lists and the join beyond them give the same."""
    monkeypatch.setattr(quality_rules, "FEW_LINES", few)
    monkeypatch.setattr(quality_rules, "HOST_LINES", longest)
    rng = random.Random(6)
    common = [prose(rng, n, 4000) for n in (1, 3, 30)]
    rows = []
    for i in range(60):
        host = ["h", "g", None][i % 3]
        lines = [prose(rng, rng.randrange(20, 60), 4000) for _ in range(3)]
        for c in common:
            if rng.random() < 0.7:
                lines.insert(rng.randrange(len(lines) + 1), rng.choice([c, f"  {c.upper()}\t", c.replace(" ", " \t ")]))
        lines.insert(rng.randrange(len(lines) + 1), " \t" if i % 4 else "")
        rows.append((i, "\n".join(lines), "aa", host, 0))
    rows += [(100 + i, "a copy\n" + prose(random.Random(1), 60, 4000), "aa", "h", 0) for i in range(30)]  # one document, so no line of it goes
    rows += [(200 + i, "\n".join(f"menu {k}" for k in range(300)) + f"\nown {i}", "aa", "m", 0) for i in range(15)]
    rows += [(300, None, "aa", "h", 0), (301, "", "aa", None, 0), (302, " \n\t\n", "aa", "g", 0), (303, common[2], "aa", "h", 0), (None, rows[0][1], "aa", "h", 0), rows[1], rows[1]]

    def normal(line):
        return " ".join(words(line)).lower()

    texts, held = defaultdict(set), defaultdict(set)
    for _, text, _, host, _ in rows:
        texts[host].add(text or "")
        for x in (text or "").split("\n"):
            held[host, normal(x)].add(text)
    often = {(h, x) for (h, x), t in held.items() if x and len(t) > 10 and len(t) > 0.02 * len(texts[h])}
    assert len(often) > 300 and {h for h, _ in often} == {"h", "g", None, "m"}
    left = [None if t is None else "\n".join(x for x in t.split("\n") if (h, normal(x)) not in often) for _, t, _, h, _ in rows]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)).collect()
    want = [(i, t, len(words(r)) - len(words(t)), len(words(t)) < 0.5 * len(words(r))) for (i, r, *_), t in zip(rows, left, strict=True)]
    assert sorted(map(repr, ((r.doc_id, r.text, r.removed_words) for r in got))) == sorted(repr(w[:3]) for w in want)
    lost = {w[0] for w in want if w[3]}
    assert lost and all(r.kept == (not r.base_failed and r.doc_id not in lost) for r in got)
    assert any(r.kept and r.removed_words for r in got) and any(not r.kept and not r.base_failed for r in got)


@pytest.mark.parametrize("parts,frequent", [(4096, 65_536), (3, 65_536), (7, 0)])
def test_kneser_ney_layout_changes_nothing(spark, docs, monkeypatch, parts, frequent):
    """Slices, parts, files of several slices and spread words are a matter of place, not of counts."""
    one = sorted((repr(r.doc_id), r.n_known, round(r.score, 9)) for r in kneser_ney.score_documents(docs).collect())
    for name, value in (("SLICE_BYTES", 900), ("PARTS", parts), ("FREQUENT", frequent), ("CHUNK_TOKENS", 500), ("SAMPLE_BYTES", 20_000)):
        monkeypatch.setattr(kneser_ney, name, value)
    lay = kneser_ney.layout(docs)
    assert lay.slices > 20 and lay.parts == min(parts, lay.slices) and (len(lay.names) > 0) == (frequent > 0)
    own = [lay.part(s) for s in range(lay.slices)]
    assert all(lay.first_slice(p) == own.index(p) for p in range(lay.parts)) and lay.first_slice(lay.parts) == lay.slices
    many = sorted((repr(r.doc_id), r.n_known, round(r.score, 9)) for r in kneser_ney.score_documents(docs).collect())
    assert many == one


def test_frequent_words_are_spread():
    rng = np.random.default_rng(1)
    first, second = np.full(100_000, 5, dtype=np.uint64), rng.integers(0, 2**63, 100_000, dtype=np.uint64) * np.uint64(2)
    lay = kneser_ney.Layout(1000, np.array([5], dtype=np.uint64), np.array([400], dtype=np.uint64))
    counts = np.bincount(lay.of_pair(first, second), minlength=1000)
    assert counts.max() < 100_000 / 50 and (lay.of_pair(first, second) == lay.of_pair(first, second)).all()


def test_frequent_pairs_keep_their_counts(spark):
    """Counts above a byte stand apart in the model's files."""
    rows = [(2, "xx yy " * 300, "aa", "s", 0), (4, "xx zz", "aa", "s", 0)]
    got = {r.doc_id: r for r in kneser_ney.score_documents(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    b = Counter()
    for _, text, *_ in rows:
        t = [*text.split(), "</s>"]
        b.update(zip(["<s>", *t], t, strict=False))
    cont, db = Counter(w for _, w in b), kneser_ney.discounts([sum(k == j for k in b.values()) for j in (1, 2, 3, 4)])
    dw = kneser_ney.discounts([sum(k == j for k in cont.values()) for j in (1, 2, 3, 4)])
    floor = sum(dw[min(k, 3)] for k in cont.values()) / len(b) / (len(cont) + 1)

    def p(h, w):
        low = max(cont[w] - dw[min(cont[w], 3)], 0) / len(b) + floor
        ctx = sum(k for (x, _), k in b.items() if x == h)
        back = sum(db[min(k, 3)] for (x, _), k in b.items() if x == h)
        return (max(b[h, w] - db[min(b[h, w], 3)], 0) + back * low) / ctx

    assert b["xx", "yy"] == 300
    for i, text, *_ in rows:
        t = [*text.split(), "</s>"]
        assert got[i].score == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(["<s>", *t], t, strict=False)))
