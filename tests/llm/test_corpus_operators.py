"""Operators that look at many rows at once: SimHash, sharding, neighbours, tokens, mixing, suffixes."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidepanel.llm.common import is_scan, table, with_row_id
from tidepanel.llm import components, mixing, nearest, queries, secrets_scan, sharding, simhash, suffixes, tokens

SF = "/root/testdata/sf0.001"


def groups_of(nodes, linked):
    """Brute-force components: ``{node: smallest node}``."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- SimHash ---------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(edge_rows):
    rng = random.Random(1)
    texts = [r[1] for r in edge_rows] + [" ".join(rng.choice(["a", "B", "ÄÖ", "\x0b", "x y"]) for _ in range(n))
                                         for n in range(40)]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 3])
def test_every_pair_within_the_radius_collides(radius):
    masks = simhash.covering_masks(radius)
    rng = random.Random(2)
    for _ in range(5000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(radius + 1)))
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("size", [5, 300, 4000])
def test_spanning_links_connect_what_pairs_connect(size):
    rng = random.Random(size)
    centres = [rng.getrandbits(64) for _ in range(max(1, size // 500))]
    values = {c ^ sum(1 << b for b in rng.sample(range(16), rng.randrange(9)))
              for c in centres for _ in range(size // len(centres))}
    array = np.array(sorted(values), dtype=np.uint64)
    links = simhash.spanning_links(array, 3)
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    near = np.argwhere(np.triu(np.bitwise_count(array[:, None] ^ array[None, :]) <= 3, 1))
    expected = groups_of(values, [(int(array[i]), int(array[j])) for i, j in near])
    assert groups_of(values, links) == expected


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 300), (400, 401)] * 2
    rng = random.Random(3)
    names = rng.sample(range(10_000), 500)
    edges = [(names[a], names[b]) for a, b in edges]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.connected_components(frame).collect()}
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert got == groups_of(nodes, [(a, b) for a, b in edges if a != b])
    assert components.connected_components(frame.where("false")).count() == 0


def expected_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    distinct = sorted({p for _, p in prints})
    linked = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:] if (a ^ b).bit_count() <= 3]
    root = groups_of(distinct, linked)
    smallest = {}
    for i, p in prints:
        if i is not None:
            smallest[root[p]] = min(i, smallest.get(root[p], i))
    return prints, root, smallest


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    prints, root, smallest = expected_components(rows)
    got = {(r.doc_id, r.fingerprint, r.component_id)
           for r in queries.QUERIES["op4_simhash_near_dedup"](spark, SF).collect()}
    assert got == {(i, f"{p:016x}", smallest[root[p]]) for i, p in prints}


def test_simhash_of_edge_rows(edge_docs, edge_rows, no_docs):
    rows = [(i, t) for i, t, _ in edge_rows]
    prints, root, smallest = expected_components(rows)
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id)
                  for r in simhash.simhash_components(edge_docs).collect())
    assert got == Counter((i, p, smallest.get(root[p])) for i, p in prints)
    kept = simhash.near_deduplicated(edge_docs)
    assert kept.columns == edge_docs.columns
    kept = kept.collect()
    assert Counter(root[plain_fingerprint(r.text)] for r in kept) == Counter(set(root.values()))
    assert all(r.doc_id == smallest.get(root[plain_fingerprint(r.text)]) for r in kept)
    assert simhash.simhash_components(no_docs).count() == simhash.near_deduplicated(no_docs).count() == 0


# ---- sharding --------------------------------------------------------------------------------------------------


def test_sharding_of_edge_rows(edge_docs, edge_rows, no_docs):
    written = sharding.write_shards(edge_docs, shards=4, bucket_bytes=100_000)
    rows = sharding.unpacked(written).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in rows) == Counter(edge_rows)
    slots = defaultdict(list)
    for r in written.collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 4
    assert sharding.write_shards(no_docs).count() == 0


def test_sharding_query_is_a_repeatable_permutation(spark):
    rows = queries.QUERIES["op6_sharding"](spark, SF).collect()
    again = queries.QUERIES["op6_sharding"](spark, SF).collect()
    assert sorted(rows) == sorted(again)
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) == 200
    assert sorted(r.doc_id for r in rows) == list(range(200))
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    # The order is no longer that of the ids.
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert abs(np.corrcoef(order, range(200))[0, 1]) < 0.3


def test_fisher_yates_is_uniform():
    counts = Counter(tuple(sharding.fisher_yates(3, seed)) for seed in range(6000))
    assert len(counts) == 6 and max(counts.values()) < 1.2 * min(counts.values())


# ---- nearest neighbours ----------------------------------------------------------------------------------------


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 1500)) * 10 ** rng.uniform(-3, 3, size=(200, 1))
    codes, scales, kept, lost = nearest.quantised(x)
    about = nearest.code_products(codes, codes) * scales[:, None] * scales
    bound = lost[:, None] * (kept + lost) + kept[:, None] * lost
    assert (np.abs(x @ x.T - about) <= bound * (1 + 1e-9)).all()


def test_neighbours_equal_a_full_search(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=6).round(1).tolist() for i in range(700)}
    for i in range(100, 200):
        vectors[i] = vectors[0]  # ties
    vectors |= {700: None, 701: [0.0] * 6, 702: [1.0, None, 0.0, 0.0, 0.0, 0.0], 703: [float("nan")] * 6,
                704: [float("inf")] * 6, 705: [], 706: [1.0, 2.0], 720: [3.0, 1.0], 740: [0.0] * 6, 760: [1e-320] * 6}
    rows = [(i, v, "x", "y", 0) for i, v in vectors.items()] + [(3, vectors[3], "x", "y", 0), (None, vectors[1], "x", "y", 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, v string, dim int")
    got = defaultdict(list)
    for r in nearest.nearest(frame, F.col("vec_id") % 20 == 0, query_block=7, task_rows=50).orderBy("rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    usable = {i: v for i, v in vectors.items()
              if v and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)}

    def product(a, b):
        total = 0.0
        for x, y in zip(a, b):
            total += x * y
        return total

    for q in [i for i in usable if i % 20 == 0]:
        best = sorted((-product(usable[q], v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        assert got[q] == [(n, i, -s) for n, (s, i) in enumerate(best[:20], 1)]
    assert set(got) == {i for i in usable if i % 20 == 0}
    assert nearest.nearest(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_rows_of_one_id_all_count(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.integers(-9, 10, size=4).astype(float).tolist()) for i in rng.integers(0, 120, size=400)]
    frame = spark.createDataFrame(rows + rows[:40], "vec_id long, embedding array<double>")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as connection:
        connection.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
        expected = connection.execute(queries.NEAREST_SQL).fetchall()
    got = queries.QUERIES["op7_nearest_neighbours"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    small = nearest.nearest(frame, F.col("vec_id") % 20 == 0, query_block=3, task_rows=30).collect()
    assert sorted(map(tuple, small)) == sorted(expected)


# ---- rows that a plan repeats ----------------------------------------------------------------------------------


def repeating(docs):
    """Frames that hold rows of a file more than once, though they still have that file's metadata."""
    twice = docs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("again")).drop("again")
    both = docs.join(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang")), "lang").drop("of_lang")
    return {"explode": twice, "union": docs.union(docs), "join": both.union(both), "sample": docs.sample(True, 2.0, 1),
            "scan": docs, "filter": docs.where("doc_id % 2 = 0").select("doc_id", "text", "source", "lang")}


@pytest.mark.parametrize("name", ["explode", "union", "join", "sample", "scan", "filter"])
def test_row_ids_tell_repeated_rows_apart(spark, name):
    frame = repeating(table(spark, SF, "documents"))[name]
    rows, rid = with_row_id(frame)
    assert rows.count() == rows.select(rid).distinct().count() == frame.count() > 0
    assert is_scan(frame) == (name in ("scan", "filter"))


def test_operators_on_repeated_rows(spark):
    docs = table(spark, SF, "documents")
    twice = repeating(docs)["explode"]
    n = docs.count()
    index = tokens.write_training_order(twice, shard_bytes=50_000)
    assert sorted(r.slot for r in index.select("slot").collect()) == list(range(2 * n))
    assert sharding.write_shards(twice).count() == 2 * n
    one = {r.component_id for r in simhash.simhash_components(docs).collect()}
    assert simhash.near_deduplicated(twice).count() == len(one) == simhash.near_deduplicated(docs).count()
    assert suffixes.removals(twice).count() == 2 * n


# ---- tokens ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(size):
    slots = tokens.feistel(np.arange(size), size, key=7)
    assert sorted(slots.tolist()) == list(range(size))
    if size > 100:
        assert (slots != tokens.feistel(np.arange(size), size, key=8)).any()


def decoded(index, row_tokens):
    """``{slot: (doc_id, text)}`` from the rows of the shards."""
    encoding = tokens.tokenizer(tokens.read_vocabulary(tokens.VOCABULARY))
    out, streams = {}, {}
    for r in index.collect():
        if r.shard not in streams:
            rows = list(tokens.read_rows(r.path, r.shard))
            assert all(len(x) == row_tokens for x in rows)
            streams[r.shard] = np.concatenate(rows)
        ids = streams[r.shard][r.start:r.start + r.n_tokens + 1].tolist()
        assert ids.pop() == encoding.max_token_value + 1
        out[r.slot] = (r.doc_id, encoding.decode(ids))
    return out, streams


def test_tokens_round_trip(spark, edge_docs, edge_rows, no_docs):
    index = tokens.write_training_order(edge_docs, row_tokens=64, shard_bytes=100_000)
    out, streams = decoded(index, 64)
    assert sorted(out) == list(range(len(edge_rows)))
    assert Counter(out.values()) == Counter((i, t or "") for i, t, _ in edge_rows)
    assert len(streams) > 1
    # Shards hold ranges of slots, one after the other; every row can be reached by its number.
    ordered = [r.shard for r in index.orderBy("slot").collect()]
    assert ordered == sorted(ordered)
    assert {(r.row_tokens, r.kind) for r in index.collect()} == {(64, "<u2")}
    for r in tokens.manifest(index).collect():
        assert r.rows * 64 == len(streams[r.shard])
        last = next(tokens.read_rows(r.path, r.shard, r.rows - 1))
        assert last.tolist() == streams[r.shard][-64:].tolist()
    assert all(r.crc32 == r.read_crc32 for r in tokens.read_back(index).collect())
    assert tokens.write_training_order(no_docs).count() == 0


def test_wide_tokens_are_read_as_they_were_written(spark, tmp_path):
    # A vocabulary whose ids need more than sixteen bits.
    ranks = [bytes([i]) for i in range(256)] + [b"%d" % i for i in range(10, 70_000)]
    path = tmp_path / "wide.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(ranks)))
    docs = spark.createDataFrame([(1, "69999 12 x"), (2, None)], "doc_id int, text string")
    index = tokens.write_training_order(docs, vocabulary=str(path), row_tokens=8)
    assert {r.kind for r in index.collect()} == {"<u4"}
    assert all(r.crc32 == r.read_crc32 for r in tokens.read_back(index).collect())
    first = index.where("n_tokens > 0").first()
    rows = np.concatenate(list(tokens.read_rows(first.path, first.shard)))
    assert rows.dtype == np.uint32 and len(rows) % 8 == 0 and 70_246 in rows


def test_long_runs_of_blanks():
    encoding = tokens.tokenizer(tokens.read_vocabulary(tokens.VOCABULARY))
    for run in (" " * 6000, "\n" * 6000, " \n\t" * 2500, "\u3000" * 5001):
        for text in (run, f"a{run}", f"{run}a", f"a{run}b{run}  c", f"it's{run}'s{run}9 x"):
            assert tokens.encoded(encoding, text) == encoding.encode_ordinary(text), (run[:4], text[:3])
    text = "a" + " " * 1_500_000 + "b"
    assert encoding.decode(tokens.encoded(encoding, text)) == text


def test_token_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out, _ = decoded(tokens.write_training_order(spark.read.parquet(f"{SF}/documents.parquet")), tokens.ROW_TOKENS)
    assert dict(out.values()) == docs
    rows = queries.QUERIES["op8_token_output"](spark, SF).collect()
    assert sorted(r.slot for r in rows) == list(range(len(docs)))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.slot)] == [out[s][0] for s in range(len(docs))]


# ---- mixing ----------------------------------------------------------------------------------------------------


def reshared(sizes):
    """Targets by clipping and resharing until none is above."""
    weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, clipped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in sizes if s not in clipped]
        left = total - sum(clipped.values())
        out = clipped | {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        above = [s for s in open_ if out[s] > 2 * sizes[s]]
        if not above:
            return out
        clipped |= {s: 2.0 * sizes[s] for s in above}


def test_targets_equal_clipping_in_rounds(spark):
    rng = random.Random(6)
    for _ in range(3):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 100_000]) * rng.randrange(1, 9) for i in range(11)} | {None: 500}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(frame, mixing.WEIGHTS, mixing.SHARE, mixing.MOST).collect()}
        for source, target in reshared(sizes).items():
            assert got[source] == pytest.approx(target, rel=1e-12)


def test_mix_comes_near_its_targets(spark, make_docs):
    rng = random.Random(7)
    rows = [(i, " ".join("w" * rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(3000)]
    rows += [(5000 + i, "copy " * 20, "a") for i in range(1500)]
    mix = mixing.mix_sources(make_docs(rows))
    got = mix.select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        assert 0 <= r.copies <= 2
    goals = reshared(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goals[r.source])
    for source, goal in goals.items():
        assert abs(taken[source] - goal) <= 30  # half of the largest document
    assert sorted(map(str, mix.collect())) == sorted(map(str, mixing.mix_sources(make_docs(rows)).collect()))


def test_budgets_are_nested(make_docs):
    rows = [(i, "w " * (1 + i % 7), "s") for i in range(400)]
    small, large = ({r.doc_id for r in mixing.mix_sources(make_docs(rows), share=s).where("copies > 0")
                     .select("row.doc_id").collect()} for s in (0.2, 0.5))
    assert small < large


def test_mix_of_edge_rows(edge_docs, edge_rows, no_docs):
    rows = mixing.mix_sources(edge_docs).collect()
    assert Counter((r.row.doc_id, r.row.text, r.row.source) for r in rows) == Counter(edge_rows)
    assert all(r.copies == 0 for r in rows if not (r.row.text or "").split())
    mixed = mixing.mixed_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_sources(no_docs).count() == mixing.mixed_documents(no_docs).count() == 0


# ---- suffixes --------------------------------------------------------------------------------------------------


def removed_by_brute_force(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = suffixes.merged([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i:i + length]] > 1])
        out.append((spans, hashlib.sha256(suffixes.kept_text(t, spans)).hexdigest()))
    return out


def test_deep_shallow_sorts():
    rng = random.Random(8)
    for _ in range(60):
        base = bytes(rng.choice(b"ab") for _ in range(300))
        strings = [base[:rng.randrange(301)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(5)))
                   for _ in range(rng.randrange(1, 80))]
        order, lengths = suffixes.deep_shallow(strings)
        assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
        for a, b, n in zip(order, order[1:], lengths):
            a, b = strings[a], strings[b]
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_sliding_minimum():
    rng = np.random.default_rng(9)
    for n, w in ((5, 5), (17, 4), (100, 7), (64, 64)):
        x = rng.integers(0, 50, n).astype(np.uint64)
        assert suffixes.sliding_minimum(x, w).tolist() == [x[i:i + w].min() for i in range(n - w + 1)]


def test_pairs_and_classes_agree():
    rng = random.Random(10)
    for _ in range(40):
        core = bytes(rng.choice(b"ab") for _ in range(6))
        members = []
        for _ in range(rng.randrange(2, 30)):
            least, back = sorted((rng.randrange(15), rng.randrange(15)))
            left = bytes(rng.choice(b"ab") for _ in range(back))
            right = core + bytes(rng.choice(b"ab") for _ in range(20 - least - 6))
            members.append((least, back, left, right))
        by_pairs = suffixes.repeated_offsets(members, 20)
        limit, suffixes.PAIRWISE = suffixes.PAIRWISE, 1
        try:
            assert suffixes.repeated_offsets(members, 20) == by_pairs
        finally:
            suffixes.PAIRWISE = limit


def test_slices_tell_which_windows_are_equal():
    """Members of two tasks: equal windows have equal cores, and equal wholes have equal windows only."""
    rng = random.Random(13)
    length, gram = 40, 6
    core = bytes(rng.choice(b"ab") for _ in range(gram))
    base = bytes(rng.choice(b"ab") for _ in range(34)), bytes(rng.choice(b"ab") for _ in range(34))

    def varied(part, at):
        return bytes(c ^ 1 if i == at else c for i, c in enumerate(part))

    members = []
    for _ in range(100):
        least, back = sorted((rng.randrange(35), rng.randrange(35)))
        left, right = varied(base[0], rng.randrange(60)), core + varied(base[1], rng.randrange(60))
        members.append((least, back, left[len(left) - back:], right[:length - least]))
    each = [list(suffixes.distinct_slices([m], length, gram)) for m in members]
    for (least, back, _, _), found in zip(members, each):
        assert [o for _, low, high, _, _ in found for o in range(low, high + 1)] == list(range(least, back + 1))

    def window(member, offset):
        return member[2][len(member[2]) - offset:] + member[3][:length - offset]

    equal = 0
    for a, found in zip(members, each):
        for b, others in zip(members, each):
            for _, low, high, own, whole in found:
                for _, low2, high2, own2, whole2 in others:
                    same = [window(a, o) == window(b, o) for o in range(max(low, low2), min(high, high2) + 1)]
                    equal += any(same) and a is not b
                    assert own == own2 or not any(same)
                    assert whole != whole2 or (all(same) and (low, high) == (low2, high2))
    assert equal > 1000


@pytest.mark.parametrize("bucket", [3, 20_000])
def test_repeats_equal_brute_force(spark, make_docs, bucket):
    """Small windows; with buckets of three, frequent grams are dealt to several tasks."""
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = []
    for i in range(120):
        text = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 90)))
        kind = i % 6
        if kind == 0:
            cut = rng.randrange(25)
            text = text[:40] + passage[cut:cut + rng.randrange(15, 36)] + text[40:]
        elif kind == 1:
            text += rng.choice(["ab", "abc", "é", "a"]) * rng.randrange(5, 60)
        elif kind == 2 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 3 and rows:
            other = rows[rng.randrange(len(rows))][1]
            text = other[:20] + "#" + other[21:]
        rows.append((i, text, "s"))
    texts = [t.encode() for _, t, _ in rows]
    got = {r.doc_id: ([(s.start, s.stop) for s in r.spans], r.kept_sha256)
           for r in suffixes.removals(make_docs(rows), length=20, gram=6, bucket=bucket).collect()}
    expected = removed_by_brute_force(texts, 20)
    assert {i: got[i] for i in range(len(rows))} == dict(enumerate(expected))
    assert sum(bool(s) for s, _ in expected) > 50


def test_long_texts_are_whole(make_docs):
    rng = random.Random(12)
    big = "".join(rng.choices("abcdefghijklmnop ", k=2_500_000))
    # Repeats across the border of two blocks, and between the ends of one text.
    at = suffixes.BLOCK - 200
    rows = [(1, big, "s"), (2, "x" * 10 + big[at:at + 700] + "y", "s"), (3, big[-450:] + "z", "s"), (4, big[:399], "s")]
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in suffixes.removals(make_docs(rows)).collect()}
    n = len(big)
    assert got == {1: [(at, at + 700), (n - 450, n)], 2: [(10, 710)], 3: [(0, 450)], 4: []}


def test_suffix_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    expected = removed_by_brute_force(list(docs.values()), 400)
    got = {r.doc_id: r for r in queries.QUERIES["op10_suffix_dedup"](spark, SF).collect()}
    for (i, text), (spans, digest) in zip(docs.items(), expected):
        removed = sum(b - a for a, b in spans)
        assert tuple(got[i]) == (i, len(text), removed, len(spans), digest)


def test_suffixes_of_edge_rows(edge_docs, edge_rows, no_docs):
    rows = suffixes.removals(edge_docs).collect()
    # Only the two long texts repeat themselves; each wholly.
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in edge_rows)
    assert {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in rows if r.spans} == {
        7: [(0, 300_000)], 8: [(0, len(("äöü ñ 漢字 " * 50).encode()))], 9: [(0, 200_000)]}
    left = suffixes.without_repeats(edge_docs)
    assert left.columns == edge_docs.columns
    assert Counter(r.text or b"" for r in left.collect())[b""] == 3 + 4
    assert suffixes.removals(no_docs).count() == suffixes.without_repeats(no_docs).count() == 0


def test_digest_of_no_spans():
    assert secrets_scan.sha256_text("") == hashlib.sha256(b"").hexdigest()
