"""Operators on token sequences and conversations against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from tidepanel.llm import alignment, blocks, pieces, prefix_trie, queries
from tidepanel.llm.common import table

SF = "/root/testdata/sf0.001"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
LEFT = Tokenizer.from_file(alignment.BYTE_BPE)
LEFT.encode_special_tokens = True
AWKWARD = [
    "", " ", "   ", "a", " a", "a ", "  a  b ", "a▁b", "▁", "▁▁ x", "<s> </s> <unk> <0x41>", "<|endoftext|> x", "\x00 \x01",
    "\n\n\t x\r\n", "é漢字😀 ñ", "\u3000wide\u00a0", "e\u0301 ﬁ Ａ", "y" * 5000, "ab" * 3000, " " * 3000 + "x", "\u2028 \ufeff\ufffd",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- blocks ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("numbers", [[], [0], [1, 255, 256, 65_536, (1 << 32) - 1], list(range(5000))])
def test_packed_numbers(numbers):
    assert blocks.unpacked(blocks.packed(numbers)).tolist() == numbers


# ---- pieces ----------------------------------------------------------------------------------------------------


def test_chunks_are_segmented_as_within_their_text():
    model = pieces.pieces(pieces.read_model(pieces.MODEL))
    assert model.cuts
    rng = random.Random(4)
    texts = AWKWARD + ["".join(rng.choice("ab ▁\n.é漢😀") for _ in range(rng.randrange(60))) for _ in range(500)]
    for text in texts:
        ids = model.encode(model.chunks(text))
        assert [i for part in ids for i in part] == LIBRARY.encode(text)
        assert model.joined(model.decode(ids)) == LIBRARY.decode(LIBRARY.encode(text))


def plain_pieces(text):
    ids = LIBRARY.encode(text or "")
    return ids, LIBRARY.decode(ids)


@pytest.mark.parametrize("block_chars", [20, 1 << 20])
def test_pieces_of_edge_rows(spark, edge_docs, edge_rows, no_docs, make_docs, block_chars):
    got = pieces.encoded(edge_docs, block_chars=block_chars).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == Counter(
        (i, tuple(ids), text) for i, t, _ in edge_rows for ids, text in [plain_pieces(t)])
    docs = make_docs([(i, t, "a") for i, t in enumerate(AWKWARD)])
    got = {r.doc_id: (r.ids, r.decoded) for r in pieces.encoded(docs.repartition(3), block_chars=block_chars).collect()}
    assert got == {i: plain_pieces(t) for i, t in enumerate(AWKWARD)}
    assert pieces.encoded(no_docs).count() == 0
    named = spark.createDataFrame([("x", "a b")], "name string, ids string")
    assert pieces.encoded(named, doc_id="name", text="ids").first().decoded == "a b"


def test_models_that_allow_no_cut_take_whole_texts(spark, tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(pieces.read_model(pieces.MODEL))
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(proto.SerializeToString())
    assert not pieces.pieces(path.read_bytes()).cuts
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = [t for t in AWKWARD if t] * 2 + [""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.ids, r.decoded) for r in pieces.encoded(docs, model=str(path)).collect()}
    assert got == {i: (library.encode(t), library.decode(library.encode(t))) for i, t in enumerate(texts)}


def test_pieces_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_sentencepiece"](spark, SF).collect()}
    expected = {}
    for doc in table(spark, SF, "documents").collect():
        ids, text = plain_pieces(doc.text)
        expected[doc.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(text))
    assert got == expected


# ---- alignment -------------------------------------------------------------------------------------------------

PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)}


def left_bytes(i):
    return bytes(BYTE[c] for c in LEFT.id_to_token(i))


def right_bytes(i):
    piece = LIBRARY.id_to_piece(i)
    found = re.fullmatch("<0x(..)>", piece)
    return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()


def plain_alignment(texts):
    """Of each text ``(n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``, token by token."""
    linked, groups_of, held = [], [], Counter()
    for text in texts:
        a, b = LEFT.encode(" " + (text or ""), add_special_tokens=False).ids, LIBRARY.encode(text or "")
        data = (" " + (text or "")).encode()
        if not text or b"".join(map(left_bytes, a)) != data or b"".join(map(right_bytes, b)) != data:
            linked.append(None)
            groups_of.append([])
            continue
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((left_bytes, a), (right_bytes, b))]
        shared = set(ends[0]) & set(ends[1])
        parts = []
        for ids, stops in zip((a, b), ends):
            side, now = [], []
            for i, stop in zip(ids, stops):
                now.append(i)
                if stop in shared:
                    side.append(now)
                    now = []
            parts.append(side)
        groups_of.append(list(zip(*parts)))
        linked.append([(x, y) for p, q in zip(*parts) for x in p for y in q])
        held.update(set(linked[-1]))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for links, groups in zip(linked, groups_of):
        if links is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        named = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links),
                    sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), named))
    return out


def test_both_libraries_encode_alike():
    model = alignment.byte_bpe(alignment.read_model(alignment.BYTE_BPE))
    assert model.ranked is not None
    rng = random.Random(8)
    texts = [t for t in AWKWARD if t] + ["".join(rng.choice("ab '\n.é漢1s😀\u3000") for _ in range(rng.randrange(80)))
                                        for _ in range(500)]
    texts += ["x" + " " * 1_200_000 + "y"]
    for text in texts:
        assert model.encode(text).tolist() == LEFT.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block_chars", [30, 1 << 20])
def test_alignment_of_awkward_texts(make_docs, block_chars):
    rng = random.Random(6)
    texts = AWKWARD + [None, "the cat", "the cat"] + [
        "".join(rng.choice(["the", " ", "in", "ö", "漢", "X", "\n", "ing", "9"]) for _ in range(rng.randrange(50)))
        for _ in range(120)]
    docs = make_docs([(i, t, "a") for i, t in enumerate(texts)]).repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.aligned(docs, block_chars=block_chars).collect()}
    assert got == dict(enumerate(plain_alignment(texts)))


def test_alignment_of_edge_rows(edge_docs, edge_rows, no_docs):
    got = alignment.aligned(edge_docs).collect()
    expected = plain_alignment([t for _, t, _ in edge_rows])
    assert Counter(map(tuple, got)) == Counter((i, *e) for (i, _, _), e in zip(edge_rows, expected))
    assert alignment.aligned(no_docs).count() == 0


def test_large_groups_are_linked_by_distinct_ids(monkeypatch):
    draw = np.random.default_rng(3)
    na, nb = draw.integers(1, 9, 40), draw.integers(1, 9, 40)
    made = alignment.Table(draw.integers(0, 5, na.sum()), draw.integers(0, 5, nb.sum()), na, nb, [10, 1, 9, 20])
    results = []
    for most in (1 << 20, 0):
        monkeypatch.setattr(alignment, "MOST_CELLS", most)
        pairs, entries, place, weight = made.links()
        window = np.repeat(np.arange(4), entries)
        total = Counter()
        for w, p, n in zip(window.tolist(), pairs[place].tolist(), weight.tolist()):
            total[w, p] += n
        results.append(total)
    assert results[0] == results[1] and sum(results[0].values()) == int((na * nb).sum())


def test_alignment_query(spark):
    docs = table(spark, SF, "documents").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_token_alignment"](spark, SF).collect()}
    expected = plain_alignment([d.text for d in docs])
    assert got == {d.doc_id: (*e[:6], sha(e[6]) if e[6] else "") for d, e in zip(docs, expected)}


# ---- conversations ---------------------------------------------------------------------------------------------


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(found)] for c, found in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, turns_of in whole.items():
        for depth in range(len(turns_of) + 1):
            members[turns_of[:depth]].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below[node] = (sum(below[k][0] for k in children[node]) or 1,
                       (len(members[node]) - 1) * words + sum(below[k][1] for k in children[node]))
    return Counter((
        min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), *below[node],
        sha(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(node)))))) for node, m in members.items())


def trie_rows(frame):
    return Counter(tuple(r) for r in prefix_trie.prefix_trie(frame).collect())


COLUMNS = "conv_id bigint, turn bigint, role string, text string, depth string, x string, n string, k string"


@pytest.mark.parametrize("seed", range(4))
def test_trie_equals_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", [1, 2, 4, 7][seed])
    monkeypatch.setattr(prefix_trie, "SEGMENT_BLOCKS", [2, 1, 3, 1024][seed])
    rows = []
    for conv in rng.sample(range(-60, 200), 110) + [10**15, 10**15 + 1]:
        length = rng.choice([1, 1, 2, 3, 5, 9, 14])
        rows += [(conv, t, rng.choice(["user", None]), rng.choice(["a b", "a  c d", "", None, "a"]))
                 for t in range(length)]
    rows += [(200 + i, t, "user", "same words here" if t < 17 else "end") for i in range(30) for t in range(18 + i % 2)]
    rows += [(None, 1, "user", "nobody"), (40, None, "user", "first"), (40, 0, "user", "tie"), (40, 0, "user", "tie")]
    frame = spark.createDataFrame([(*r, None, None, None, None) for r in rows], COLUMNS).repartition(5)
    assert trie_rows(frame) == plain_trie(rows)


def test_trie_of_awkward_tables(spark):
    one = [(7, None, None, None)]
    for rows in (one, one * 3, [(20, 0, "a", "b"), (21, 0, "a", "b")], [(3, 1, "a:b", "c"), (4, 1, "a", "b:c")],
                 [(5, 1, "x", "long " * 50_000), (25, 1, "x", "long " * 50_000)]):
        frame = spark.createDataFrame([(*r, None, None, None, None) for r in rows], COLUMNS)
        assert trie_rows(frame) == plain_trie(rows)
    empty = spark.createDataFrame([(None, 1, "a", "b", None, None, None, None)], COLUMNS)
    assert trie_rows(empty) == Counter() == trie_rows(empty.where(F.lit(False)))


def test_trie_query(spark):
    rows = table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()
    got = queries.QUERIES["op13_prefix_trie"](spark, SF)
    assert Counter(map(tuple, got.collect())) == plain_trie([tuple(r) for r in rows])
    assert all(f.dataType.simpleString() == ("string" if f.name == "ends_sha256" else "bigint") for f in got.schema)


def test_models_are_parameters():
    assert alignment.BYTE_BPE == public_tokenizers.path("byte_bpe_50k.json")
    assert pieces.MODEL == public_tokenizers.path("piece_bpe_32k.model")
