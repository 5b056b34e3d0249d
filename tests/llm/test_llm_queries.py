"""The queries themselves on whole tables: columns, SQL, and results worked out apart from the operators."""

import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylight.llm import ann, embedding_dedup, language_id, queries, toxicity
from quarrylight.llm.common import table

DIR, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "documents embeddings pages labels".split()
COLUMNS = {
    "op1_lm_scoring": "doc_id n_words target_loss background_loss difference", "op2_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op3_nearest_neighbours": "query_id rank vec_id score",
    "op4_toxicity": "doc_id held_out score predicted", "op5_html_extraction": "page_id url text n_chars", "op6_language_id": "doc_id held_out lang_pred score", "op7_simhash_dedup": "doc_id fingerprint component_id",
    "op8_embedding_dedup": "vec_id n_links component_id kept", "op9_source_mixing": "doc_id size source_size target taken copies", "op10_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op11_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score", "op12_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op13_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
}


def test_columns(spark):
    assert {name: " ".join(q(spark, DIR).columns) for name, q in queries.QUERIES.items()} == COLUMNS


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    plain = lambda rows: sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    df = queries.QUERIES[name](spark, DIR)
    want = db.sql(queries.ORACLES[name])
    order = [want.columns.index(c) for c in sorted(df.columns)]
    assert plain(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == plain(tuple(r[i] for i in order) for r in want.fetchall())


def remainder(doc, modulus):
    return zlib.crc32(str(doc).encode()) % modulus


def test_sharding_against_one_pass(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark, LARGER, "documents").collect())
    whole = sum(len((t or "").encode()) + 1 for _, t in docs)
    got, upto, slots = {r["doc_id"]: r for r in queries.op2_sharding(spark, LARGER).collect()}, 0, {}
    for doc, text in docs:
        body = (text or "").encode()
        upto += len(body) + 1
        shard = min(7, (2 * upto - len(body) - 1) * 8 // (2 * whole))
        slot = slots[shard] = slots.get(shard, -1) + 1
        assert tuple(got[doc])[1:] == (len(body) + 1, zlib.crc32(body), "bytes", shard, slot, None)
    assert len(got) == len(docs) and len(slots) == 8


def naive_margin(model, word):
    """The mean margin of a word's subwords, hashed letter by letter."""
    bare = word.strip(toxicity.EDGES)
    if not any(c.isalnum() for c in bare):
        return None
    points, mask, keys = [ord(c) for c in f"<{bare}>"], (1 << 64) - 1, []
    for n in toxicity.NGRAMS:
        for i in range(len(points) - n + 1):
            h = 0
            for k, p in enumerate(points[i : i + n], 1):
                h = (h * 1_000_003 + p + k) & mask
            keys.append(h)
    whole, power = 0, 1
    for p in points:
        power = power * 6_364_136_223_846_793_005 & mask
        whole = whole + (p + 7) * power & mask
    buckets = [((k ^ k >> 29) * 0x9E3779B97F4A7C15 & mask) >> (64 - toxicity.BUCKETS.bit_length() + 1) for k in [*keys, whole]]
    return float(np.mean([model.margins[b] for b in buckets]))


def test_toxicity_query(spark):
    docs, marks = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    got = {r["doc_id"]: r for r in queries.op4_toxicity(spark, LARGER).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    assert all(r["held_out"] == (remainder(i, 5) == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in got.items())
    # The score of a text is what its words' margins say, and held-out labels do not move it.
    turned = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    train = marks.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = toxicity.fit(docs, train)
    again = toxicity.fit(docs, turned.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    assert np.array_equal(model.margins, again.margins) and model.bias == again.bias
    for i in sorted(texts)[:40]:
        margins = [m for w in (texts[i] or "").lower().split() for m in [naive_margin(model, w)] if m is not None]
        want = 1 / (1 + np.exp(-(sum(margins) / (len(margins) + toxicity.PRIOR_WORDS) + model.bias)))
        assert abs(got[i]["score"] - want) < 1e-4


def test_toxicity_on_held_out_rows(spark):
    """On the tables with some thousand labels; the smaller ones hold a handful of toxic rows."""
    where = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r["score"] for r in queries.op4_toxicity(spark, where).filter("held_out").collect()}
    known = {r["doc_id"]: r["toxic"] for r in table(spark, where, "labels").filter("toxic IS NOT NULL").collect() if r["doc_id"] in got}
    bad, fine = ([got[i] for i, y in known.items() if y == want] for want in (1, 0))
    right = sum(s >= 0.5 for s in bad) + sum(s < 0.5 for s in fine)
    assert right / len(known) > 0.92 and right > len(fine)
    assert sum((a > b) + (a == b) / 2 for a in bad for b in fine) / (len(bad) * len(fine)) > 0.9


def test_language_query(spark):
    docs = table(spark, LARGER, "documents")
    got = {r["doc_id"]: r for r in queries.op6_language_id(spark, LARGER).collect()}
    known = language_id.fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    assert all(r["held_out"] == (remainder(i, 4) == 2) for i, r in got.items())
    for r in docs.filter("doc_id % 25 = 3").collect():
        letters = [" "] + ["".join(c.lower()) if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in r["text"] or ""] + [" "]
        letters = [c for k, c in enumerate(letters) if not k or c != " " or letters[k - 1] != " "]
        bundle = np.zeros(language_id.WIDTH)
        for k in range(len(letters) - 2):
            bundle += np.prod([np.roll(language_id.letter(ord(c)).astype(int), 2 - j) for j, c in enumerate(letters[k : k + 3])], axis=0)
        if not any(c != " " for c in letters):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        cosines = known.vectors @ bundle / np.linalg.norm(bundle)
        assert known.languages[int(cosines.argmax())] == got[r["doc_id"]]["lang_pred"] and abs(got[r["doc_id"]]["score"] - max(0, cosines.max())) < 1e-3


def test_simhash_query(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, DIR, "documents").collect()}
    prints = {}
    for i, text in docs.items():
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        made = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in made]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: min(j for j, p in prints.items() if bin(p ^ prints[i]).count("1") <= 2) for i in prints}
    while any(root[root[i]] != root[i] for i in root):
        root = {i: root[root[i]] for i in root}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash_dedup(spark, DIR).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_vectors_with_other_columns(spark):
    """Clashing names, nulls in every column, repeated rows, a hot label, and empty tables."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.01).astype(float).tolist(), 1, "x", 2, True, [1]) for i in range(60)]
    rows += [(None, [1.0] * 8, 1, "x", 2, True, [1]), (100, [1.0] * 8, None, None, None, None, None), (101, None, 1, "x", 2, True, [1]), (5, rows[5][1], 1, "x", 2, True, [1]), (102, [], 1, "x", 2, True, [1])]
    schema = "vec_id long, embedding array<float>, label int, list string, weight int, asks boolean, probes array<int>"
    vectors = spark.createDataFrame(rows, schema)
    found = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(vectors).collect() if r["vec_id"] is not None}
    v = {r[0]: np.array(r[1]) for r in rows if r[0] is not None and r[1] and r[2] is not None}
    cosine = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
    assert embedding_dedup.near_duplicates(vectors).count() == len(rows) and found[100]["n_links"] == 0 and found[101]["kept"]
    assert all(found[i]["n_links"] == sum(cosine(i, j) >= 0.98 for j in range(60) if j != i) + (cosine(i, 5) >= 0.98) for i in range(60) if i != 5)
    near = ann.search(vectors, F.col("vec_id") % 20 == 0)
    assert near.columns == ["query_id", "rank", "vec_id", "score"]
    assert {r["query_id"] for r in near.collect()} == {0, 20, 40, 100}
    for op in (embedding_dedup.near_duplicates(vectors.limit(0)), ann.search(vectors.limit(0), F.lit(True))):
        assert op.count() == 0


def recalled(vectors, got, top=20):
    """The share of the true nearest rows that a search found, and whether each row's score and order are right."""
    ids, rows = np.array([r["vec_id"] for r in vectors]), np.array([r["embedding"] for r in vectors], np.float64)
    at, found, whole = {i: n for n, i in enumerate(ids.tolist())}, 0, 0
    for query in {r["query_id"] for r in got}:
        mine = sorted((r for r in got if r["query_id"] == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len({r["vec_id"] for r in mine}) == len(mine)
        assert all(abs(r["score"] - rows[at[r["vec_id"]]] @ rows[at[query]]) < 1e-12 for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        scores = rows @ rows[at[query]]
        scores[at[query]] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:top]].tolist())
        found, whole = found + len(best & {r["vec_id"] for r in mine}), whole + len(best)
    return found / whole


@pytest.mark.parametrize("where", [DIR, LARGER, "/root/testdata/sf0.1"])
def test_neighbours_query(spark, where):
    """The query against all pairs, at three sizes."""
    rows = table(spark, where, "embeddings").collect()
    got = queries.op3_nearest_neighbours(spark, where).collect()
    assert {r["query_id"] for r in got} == {r["vec_id"] for r in rows if r["vec_id"] % 20 == 0} and len(got) == 20 * len({r["query_id"] for r in got})
    assert recalled(rows, got) >= 0.9


def test_neighbours_of_two_levels(spark, monkeypatch):
    """Partitions with routers of their own: each query still finds what it should."""
    monkeypatch.setattr(ann, "PART_ROWS", 40)
    monkeypatch.setattr(ann, "MAX_PARTS", 16)
    monkeypatch.setattr(ann, "ROWS", 50)
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = ann.search(vectors, F.col("vec_id") % 20 == 0).collect()
    assert len(got) == 20 * 100 and recalled(vectors.collect(), got) >= 0.9


def test_neighbours_of_repeated_rows(spark, tmp_path):
    """A query that stands twice has each neighbour once; one id with two vectors asks with both."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist(), 1) for i in range(61)]
    rows += [rows[20], rows[20], rows[5], rows[5], (40, rng.normal(size=6).tolist(), 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op3_nearest_neighbours(spark, str(tmp_path)).collect()
    of = {q: [r for r in got if r["query_id"] == q] for q in (0, 20, 40, 60)}
    assert [len(of[q]) for q in (0, 20, 40, 60)] == [20, 20, 40, 20]
    assert all(len({r["vec_id"] for r in of[q]}) == 20 - (q != 40 and sum(r["vec_id"] == 40 for r in of[q]) == 2) for q in (0, 20, 60))
    assert sorted(r["rank"] for r in of[20]) == list(range(1, 21)) and not any(r["vec_id"] == 20 for r in of[20])
