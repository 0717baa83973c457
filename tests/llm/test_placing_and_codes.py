"""Sharding by a hash tree, alignment of tokenizers and vector codes: SQL or brute force, edges, movement, exactness of the search."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import OP11_SQL, OP13_SQL, op11_weighted_hash_tree, op12_token_alignment, op13_vector_codes, sharding, token_alignment, vector_codes
from foliant.llm.common import staged, table

SCHEMA = "doc_id long, text string, shard int, slot long, row string, _n long, block long, pair long, size int"
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "no id"), (None, "no id"), (5, "long " * 50_000), (4, "one"), (4, "one"), (6, "Ünïcödé — 漢字 😀 é"), (7, "<|endoftext|> <s> <0x0A> ▁x"), (8, "a\r\nb\r c  \n  d")]


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "r", 3, 4, 5, 6) for r in rows], SCHEMA)


def oracle(sf_dir, name, sql):
    con = duckdb.connect()
    con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    found = con.sql(sql)
    return found.columns, sorted(map(tuple, found.fetchall()), key=repr)


# 11


def test_sharding_equals_sql(spark, sf_dir):
    rows = op11_weighted_hash_tree(spark, sf_dir)
    columns, theirs = oracle(sf_dir, "documents", OP11_SQL)
    assert sorted(map(tuple, rows.select(columns).collect()), key=repr) == theirs


def test_sharding_edges(spark):
    rows = sharding.shard_documents(documents(spark, EDGES), sharding.shard_tree(8), sharding.shard_tree(9)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in EDGES)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] == 4}) == len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.shard_documents(documents(spark, []), sharding.shard_tree(8)).count() == 0


def test_placed_keeps_all_columns(spark):
    rows = sharding.placed(documents(spark, EDGES), sharding.shard_tree(8)).collect()
    assert Counter((r["row"]["doc_id"], r["row"]["text"], r["row"]["shard"]) for r in rows) == Counter((*e, 1) for e in EDGES)
    assert {(r["region"], r["rack"]) for r in rows} <= {(f"r{i}", f"k{j}") for i in (0, 1) for j in (0, 1)}


def test_written_shards_hold_all_documents(spark, tmp_path):
    sharding.write_shards(documents(spark, EDGES), sharding.shard_tree(8), f"file://{tmp_path}/out")
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert Counter((r["row"]["doc_id"], r["row"]["text"]) for r in rows) == Counter(EDGES)


def places(spark, tree, n=20_000):
    return {r["id"]: r["at"]["names"] + [r["at"]["shard"]] for r in spark.range(n).select("id", sharding.drawn_place(F.col("id"), tree).alias("at")).collect()}


@pytest.mark.parametrize("shards", [8, 9, 12])
def test_a_new_shard_only_takes(spark, shards):
    old, new = places(spark, sharding.shard_tree(shards)), places(spark, sharding.shard_tree(shards + 1))
    moved = [i for i in old if old[i] != new[i]]
    assert all(new[i][-1] == shards for i in moved)
    assert len(moved) == pytest.approx(len(old) / (shards + 1), rel=0.15)


def test_weights_are_met_and_movement_is_confined(spark):
    tree = {"a": {"x": {0: 1.0, 1: 3.0}, "y": {2: 4.0}}, "b": {"x": {3: 2.0, 4: 0.0}, "z": {5: 6.0}}}
    more = {"a": {"x": {0: 1.0, 1: 7.0}, "y": {2: 4.0}}, "b": tree["b"]}
    old, new = places(spark, tree), places(spark, more)
    for at, total in ((old, 16.0), (new, 20.0)):
        weights = {s: w for racks in (tree if at is old else more).values() for rack in racks.values() for s, w in rack.items()}
        counts = Counter(p[-1] for p in at.values())
        assert counts[4] == 0
        assert all(counts[s] == pytest.approx(w / total * len(at), rel=0.1) for s, w in weights.items() if w)
    for i in old:
        if old[i] != new[i]:
            assert new[i][0] == "a"  # rows move into the heavier region and inside it
            if old[i][0] == "a":
                assert new[i][1] == "a/x"  # within it into the heavier rack
                if old[i][1] == "a/x":
                    assert new[i][-1] == 1  # and in that rack to the heavier shard


@pytest.mark.parametrize("tree", [{}, {"a": {}}, {"a": {"x": {0: 0.0}}}, {"a": {"x": {0: -1.0}}}])
def test_trees_without_weight_are_errors(tree):
    with pytest.raises(ValueError):
        sharding.tree_nodes(tree)


def test_equal_rows_get_slots_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    rows = spark.createDataFrame([(0, 1)] * 50 + [(0, i) for i in range(2, 30)] + [(1, 1)] * 20, "shard int, x int")
    got = defaultdict(list)
    for r in sharding.slotted(rows).collect():
        got[r["shard"]].append(r["slot"])
    assert {s: sorted(v) for s, v in got.items()} == {0: list(range(78)), 1: list(range(20))}


# 12


def plain_alignment(texts):
    """All rows of the contract, from both tokenizers over whole texts and ends compared one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    from foliant.llm.encoding import default_tokenizer

    a = Tokenizer.from_file(default_tokenizer("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=default_tokenizer("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    docs = []
    for key, text in texts:
        docs.append((key, None))
        if not text:
            continue
        ids_a, ids_b, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) == b"".join(bytes_b) == raw:
            ends_a, ends_b = ({int(e): i + 1 for i, e in enumerate(np.cumsum([len(x) for x in xs]))} for xs in (bytes_a, bytes_b))
            groups, links, i, j = [], [], 0, 0
            for e in sorted(set(ends_a) & set(ends_b)):
                groups.append(",".join(map(str, ids_a[i : ends_a[e]])) + "|" + ",".join(map(str, ids_b[j : ends_b[e]])))
                i, j = ends_a[e], ends_b[e]
                links.append((ids_a[i - 1], ids_b[j - 1]))
            docs[-1] = (key, (len(ids_a), len(ids_b), groups, links))
    counts = Counter(link for _, d in docs if d for link in d[3])
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest()
    return Counter((k, 0, 0, 0, 0, 0, 0, "") if d is None else (k, d[0], d[1], len(d[2]), len(d[3]), sum(counts[x] == top[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), sha(d[2])) for k, d in docs)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_brute_force(spark, sf_dir):
    texts = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in op12_token_alignment(spark, sf_dir).select(COLUMNS).collect()) == plain_alignment(texts)


def test_alignment_edges_and_small_blocks(spark):
    docs = documents(spark, EDGES).repartition(3)
    for links in (1, 10, 10**6):
        rows = token_alignment.with_counts(staged(token_alignment.align_texts(docs, block_links=links)))
        assert Counter(tuple(r) for r in rows.select(COLUMNS).collect()) == plain_alignment(EDGES)
    assert token_alignment.with_counts(staged(token_alignment.align_texts(documents(spark, [])))).count() == 0
    shown = token_alignment.documents_of(token_alignment.align_texts(documents(spark, [(1, "hello world")]), keep_groups=True)).first()
    assert shown["groups_sha256"].count(";") == shown["n_groups"] - 1 and shown["groups_sha256"].count("|") == shown["n_groups"]


def test_units_give_the_ids_of_whole_texts():
    from foliant.llm.encoding import default_tokenizer

    tokens = token_alignment.TwoTokenizers(default_tokenizer("byte_bpe_50k.json"), default_tokenizer("piece_bpe_32k.model"))
    assert tokens.ranked
    rng = random.Random(5)
    parts = [" ", " ", "  ", "\n", "\r", "\t", "\n\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", " ", "　", "​", "▁", "a", "the", "don't", "'s", "'ll", "12", "½", "!", ");", "{", "é", "é", "漢", "😀", "हि", "<s>", "<|endoftext|>", "<0x0A>", "\0", "ﬁ", "X", "ſ", "İ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        units = tokens.units(" " + text)
        assert "".join(units) == " " + text
        found = tokens.ids(units)
        got = None if None in found else [[i for u in found for i in u[side]] for side in (0, 1)]
        a, b = tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)
        if got is None:
            assert b"".join(tokens.bytes_b[i] for i in b) != (" " + text).encode()
        else:
            assert got == [a, b], repr(text)


# 13


def test_codes_equal_sql(spark, sf_dir):
    rows = op13_vector_codes(spark, sf_dir)
    columns, theirs = oracle(sf_dir, "embeddings", OP13_SQL)
    assert sorted(map(tuple, rows.select(columns).collect()), key=repr) == theirs


@pytest.mark.parametrize(("low", "high", "entries", "width"), [(-1, 2, 64, 4), (-3, 4, 5, 1), (-1000, 1000, 64, 8), (0, 1, 7, 3), (-5, 5, 1, 2)])
def test_orchard_finds_the_nearest_with_ties_to_lower_indexes(low, high, entries, width):
    rng = np.random.default_rng(entries + width)
    books, rows, part = rng.integers(low, high, (3, entries, width)), rng.integers(low, high, (900, width)), np.tile(np.arange(3), 300)
    best, least = vector_codes.orchard(rows, part, books, *vector_codes.neighbour_lists(books))
    all_ = ((rows[:, None] - books[part]) ** 2).sum(2)
    assert (best == all_.argmin(1)).all() and (least == all_.min(1)).all()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error) with plain integers, for distinct ids and one length that parts divides."""
    kept = sorted((i, label, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v, label in rows)
    w = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, _, v in kept:
                members[near(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, vs in members.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out, labels = [], Counter()
    for i, label, v in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        labels[label] += out[-1][3]
    flat = ",".join(str(x) for book in books for e in book for x in e)
    return sorted([(i, c, e, labels[label], hashlib.sha256(flat.encode()).hexdigest()) for i, label, c, e in out], key=repr)


SCHEMA13 = "vec_id long, embedding array<float>, label int, code string, error long, vector string, _label string, id int, total int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "v", "l", 2, 3) for r in rows], SCHEMA13)


def coded(df):
    books = vector_codes.fit_codebooks(df)
    rows = vector_codes.with_label_error(vector_codes.encode(df, books)).collect()
    return books, sorted([(r["vec_id"], r["code"], r["error"], r["label_error"], books.sha256()) for r in rows], key=repr)


def test_codes_of_made_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(0, 0.2, 32).astype(np.float32)], i % 3 if i % 4 else None) for i in range(150)]
    good += [(200 + i, good[7][1], 1) for i in range(20)]
    bad = [(300, None, 1), (301, [float("nan")] * 32, 1), (302, [float("inf")] + [0.0] * 31, 2), (303, [None] + [0.0] * 31, 2), (304, [1.0] * 16, 2), (305, [], 0), (306, [3e38] * 32, 0)]
    books, rows = coded(vectors(spark, good + bad).repartition(5))
    assert rows == plain_codes(good)
    for i, code, error, _, _ in rows[:20]:
        whole = np.floor(256 * np.array(good[i][1])).astype(int)
        assert ((whole - books.decode(code)) ** 2).sum() == error


def test_codes_of_few_and_odd_vectors(spark):
    few = [(1, [0.5] * 16, None), (2, [-0.25] * 16, 1), (3, [0.5] * 16, None)]
    _, rows = coded(vectors(spark, few))
    assert [r[:4] for r in rows] == [(1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0), (3, "00" * 16, 0, 0)]
    odd = vectors(spark, [(None, [0.1 * i for i in range(19)], 1), (1, [0.2 * i for i in range(19)], 1), (1, [0.3 * i for i in range(19)], 1), (2, [1.0] * 3, 1)])
    books, rows = coded(odd)
    assert len(rows) == 3 and books.bounds[-1] == 19
    assert vector_codes.fit_codebooks(vectors(spark, [(1, None, 1)])) is None
    assert vector_codes.with_label_error(vector_codes.encode(vectors(spark, []), None)).count() == 0
