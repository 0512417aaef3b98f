"""Byte-pair encoding, the graph manifest and bisector clusters against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict
from functools import reduce

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, in_order
from tillwork.llm import queries, rank_bpe
from tillwork.llm.bisector_clusters import Bisectors, cluster, largest_component, with_inertia
from tillwork.llm.dag_manifest import build, folded, leaf_of, proofs, siblings_of
from tillwork.llm.tokens import vocabulary_path

NEW = ("op11_bpe_round_trip", "op12_dag_manifest", "op13_bisector_clusters")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Byte-pair encoding

ODD = [
    "", " \t\n", "It's a DON'T. x\x1cy a\x85b", "é. é… 12 <|endoftext|>x ***", "a.b. c-- d's f!'s h'll a|>.",
    "J̌ ΑΣ ΑΣ. İstanbul ﬁ Å K é H̱", "a b　c",
    "<|ENDOFTEXT|> <|endoftext|", "<|startoftext|><|endoftext|>e", "x" * 3000 + " " + "ab" * 700 + " " + "é" * 50,
    "'tis 'S \xb9\xbd ٣ \xad\xaa", "﻿bom ​zw", "漢字かな 한국어 हिन्दी", "a\x00b \x7f", "supercalifragilistic" * 2]


def test_encoder_is_the_library_on_odd_texts(library):
    chance = random.Random(7)
    signs = "abcdeXYZ'.!<|>09 \t\néÉßΣσςİı̱́̌Ḱ \xa0漢\U0001f600\x1c\x85n"
    texts = ODD + ["".join(chance.choices(signs, k=chance.randrange(50))) + chance.choice(
        ["", "<|endoftext|>", "<|startoftext|>x"]) for _ in range(3000)]
    for kept in (3, 1000):
        encoder = rank_bpe.Encoder(vocabulary_path(), kept_runs=kept)
        for start in range(0, len(texts), 700):
            some = texts[start:start + 700]
            ids, ends = encoder.encode([t.encode() for t in some])
            back = rank_bpe.decode(ids, np.r_[0, ends]).to_pylist()
            expected = library.encode_batch(some, add_special_tokens=False)
            assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [e.ids for e in expected]
            assert back == library.decode_batch([e.ids for e in expected], skip_special_tokens=False)


def test_runs_without_a_new_word(library):
    """A batch whose only new runs are special tokens, blanks or nothing; blanks are the ASCII ones."""
    encoder = rank_bpe.Encoder(vocabulary_path(), kept_runs=2)
    texts = ["<|endoftext|>", "", " \t\n\x0b\x0c\r ", "\x1c\x1d a\x1fb \x00 c", "\u2003Été\x85 x\u3000<|endoftext|>A\u0300 ", "a a  b"]
    for batch in ([], [""], texts[:1], texts[1:3], texts, texts[::-1]):
        ids, ends = encoder.encode([t.encode() for t in batch])
        parts = np.split(ids, ends)[:-1]
        assert [p.tolist() for p in parts] == [library.encode(t, add_special_tokens=False).ids for t in batch]
    ids, ends = encoder.encode([b"a\xff b", b"\xfe"])
    assert [p.tolist() for p in np.split(ids, ends)[:-1]] == [
        library.encode(t, add_special_tokens=False).ids for t in ("a\ufffd b", "\ufffd")]


def test_short_and_long_words_merge_alike(library):
    merges = rank_bpe.Encoder(vocabulary_path())._merges
    chance = random.Random(2)
    words = ["".join(chance.choices("etaoinshr", k=n)) for n in range(1, rank_bpe.SHORT + 1) for _ in range(20)]
    rows = rank_bpe.merge_words([w.encode() for w in words], merges)
    for word, row in zip(words, rows, strict=True):
        expected = library.encode(word, add_special_tokens=False).ids
        assert np.frombuffer(row, "<i4").tolist() == rank_bpe.merge_long(word.encode(), merges) == expected


def test_round_trip_of_the_documents(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = queries.op11_bpe_round_trip(spark, SMALL).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_texts_with_clashing_columns_and_none(spark):
    rows = [(1, None, 5, "x"), (1, "", 5, "y"), (None, "hello world", 5, "z"), (2, "hello world", 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    for found in (rank_bpe.decoded(rank_bpe.encoded(docs)), rank_bpe.encoded(docs, back="decoded")):
        assert sorted(found.columns) == ["decoded", "doc_id", "ids"]
        assert sorted((r["doc_id"] or 0, len(r["ids"]), r["decoded"]) for r in found.collect()) == [
            (0, 2, "hello</w> world</w>"), (1, 0, ""), (1, 0, ""), (2, 2, "hello</w> world</w>")]
    assert rank_bpe.decoded(rank_bpe.encoded(docs.limit(0))).count() == 0
    loose = spark.createDataFrame([([3306, None, -4, 99999, 49407],), (None,)], "ids array<int>")
    assert {r["decoded"] for r in rank_bpe.decoded(loose).collect()} == {"hello</w> <|endoftext|>", ""}


# Manifest

def manifest_by_hand(rows):
    """(doc_id, leaf, subroot, root, path) of (doc_id, lang, leaf) rows."""
    def levels(nodes):
        stack = [nodes]
        while len(stack[-1]) > 1:
            last = stack[-1]
            stack.append([sha("".join(last[i:i + 8])) for i in range(0, len(last), 8)])
        return stack

    def path(stack, place):
        steps = []
        for level in stack[:-1]:
            first = place // 8 * 8
            steps.append(("".join(level[first:place]), "".join(level[place + 1:first + 8])))
            place //= 8
        return steps

    groups = defaultdict(list)
    for doc_id, lang, leaf in rows:
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, doc_id))
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: levels([leaf for _, _, leaf, _ in sorted(groups[lang], key=lambda r: r[:3])]) for lang in order}
    top = levels([trees[lang][-1][0] for lang in order])
    return sorted(((doc_id, leaf, trees[lang][-1][0], top[-1][0], path(trees[lang], i) + path(top, k))
                   for k, lang in enumerate(order)
                   for i, (_, _, leaf, doc_id) in enumerate(sorted(groups[lang], key=lambda r: r[:3]))), key=str)


def rows_of(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]])
                   for r in df.collect()), key=str)


def test_paths_of_every_leaf(spark):
    """Trees of 1 to 600 leaves in 70 languages, one of them null and one empty."""
    sizes = [1, 2, 7, 8, 9, 63, 64, 65, 100, 513, 600] + [1, 3] * 30
    langs = [None, "", "é", "z", *(f"l{i}" for i in range(len(sizes)))][:len(sizes)]
    rows = [(1000 * k + i if i else None, lang, sha(f"{k}:{i}")) for k, (lang, n) in enumerate(zip(langs, sizes)) for i in range(n)]
    # Copies of a row enough to make equal nodes.
    rows += [(77, "copies", sha("same"))] * 200
    random.Random(1).shuffle(rows)
    leaves = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").repartition(7)
    manifest = build(leaves)
    found = proofs(manifest)
    assert rows_of(found) == manifest_by_hand(rows)
    assert found.where(folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    wanted = [(2,), (9003,), (9003,), (77,), (5 * 10 ** 6,), (None,)]
    asked = proofs(manifest, spark.createDataFrame(wanted, "doc_id long"))
    assert rows_of(asked) == [r for r in manifest_by_hand(rows) if r[0] in (2, 9003, 77)]


def test_leaves_and_tampering(spark):
    rows = [(1, None, "AbC é", None, 5, 0.5), (1, None, "AbC é", None, 5, 0.5), (2, "src", None, "en", None, 0.5),
            (None, None, None, None, None, None), (3, "s", "", "en", 0, 1.0), (3, "s", "LOUD " * 40_000, "fr", 0, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, n_chars long, leaf double")

    def hand(doc_id, source, text, lang, n_chars):
        values = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))
        return sha("".join(values))

    found = docs.select(leaf_of(docs).alias("h")).collect()
    assert [r["h"] for r in found] == [hand(*row[:5]) for row in rows]
    empty = build(docs.limit(0).select("doc_id", "lang", leaf_of(docs).alias("leaf")))
    assert empty.root is None and proofs(empty).count() == 0
    alone = proofs(build(docs.limit(1).select("doc_id", "lang", leaf_of(docs).alias("leaf"))))
    (row,) = alone.withColumn("siblings", siblings_of(F.col("path"))).collect()
    assert row["root"] == row["subroot"] == row["leaf"] and row["path"] == [] and row["siblings"] == ""


def test_query_finds_the_tampered_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op12_dag_manifest(spark, SMALL).collect():
        text = texts[r["doc_id"]] or ""
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in text)
        assert r["verified"] != changed


# Clusters

def clusters_by_hand(rows, clusters, rounds):
    vectors = {i: [math.floor(256 * x) for x in v] for i, v in rows.items()}
    order = sorted(vectors, key=lambda i: sha(f"2:{i}"))
    centroids = [vectors[i] for i in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for v in vectors.values():
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c
                     for k, c in enumerate(centroids)]
    return {i: nearest(v)[::-1] for i, v in vectors.items()}, centroids


def test_rounds_against_brute_force(spark):
    chance = np.random.default_rng(4)
    # Coarse values give many ties and equal centroids.
    rows = {i: [float(x) for x in chance.integers(-2, 2, 4) / 256] for i in range(300)}
    frame = spark.createDataFrame(list(rows.items()), "id long, e array<double>").repartition(5)
    found = cluster(frame, "id", "e", 12, 3, 4)
    members, centroids = clusters_by_hand(rows, 12, 3)
    assert found.centroids == centroids
    got = with_inertia(found).collect()
    assert {r["id"]: (r["cluster"], r["distance"]) for r in got} == members
    assert {r["inertia"] for r in got} == {sum(d for _, d in members.values())}
    for r in got:
        assert r["cluster_inertia"] == sum(d for k, d in members.values() if k == r["cluster"])


def test_sign_tests_are_nearest_centroids_at_the_limits():
    chance = np.random.default_rng(5)
    for most in (3, 10 ** 4, largest_component(64) - 1):
        centroids = chance.integers(-most, most + 1, (9, 64))
        centroids[7] = centroids[2]
        rows = np.vstack([chance.integers(-most, most + 1, (200, 64)), centroids, centroids[:1] * 0 + most])
        found = Bisectors.of(centroids.tolist())
        numbers = found.nearest(rows)
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in centroids] for r in rows]
        assert numbers.tolist() == [row.index(min(row)) for row in exact]
        assert found.distances(rows, numbers).tolist() == [min(row) for row in exact]


def test_awkward_vectors(spark):
    good = [0.5] * 64
    rows = [(1, good, 1), (1, good, 1), (2, None, 1), (3, good[:63], 1), (4, [*good[:63], None], 1),
            (5, [*good[:63], float("nan")], 1), (6, [*good[:63], float("-inf")], 1), (None, [-0.001] * 64, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")
    found = with_inertia(cluster(frame)).collect()
    assert sorted((r["vec_id"] or 0, r["distance"], r["inertia"]) for r in found) == [(0, 0, 0), (1, 0, 0), (1, 0, 0)]
    assert len({r["cluster"] for r in found if r["vec_id"] == 1}) == 1
    assert with_inertia(cluster(frame.limit(0))).count() == 0
    with pytest.raises(Exception, match="component too large"):
        cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("name", NEW)
def test_registered(spark, name):
    assert name in queries.QUERIES


def test_crc_of_the_sql():
    """The SQL's CRC-32 against the library's, as it decides what is tampered with."""
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents AS SELECT i AS doc_id, 'A' AS text, 'en' AS lang, 's' AS source, "
                       "1 AS n_chars FROM range(0, 3000, 7) AS r(i)")
    rows = connection.execute(queries.SQL["op12_dag_manifest"]).fetchall()
    assert {r[0] for r in rows if not r[-1]} == {i for i in range(0, 3000, 7) if zlib.crc32(str(i).encode()) % 3 == 0}
