"""The training-data operators against brute force, round trips and held-out rows, and on edge cases."""

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quarrylight.llm import ann, components, embedding_dedup, html_extract, language_id, lm_scoring, mixing, packing, queries, sharding, simhash, toxicity
from quarrylight.llm.common import table

DIR = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, "x", None, "b"), (4, "x", None, "b"), (None, "null key", "en", "a"), (5, "one two three four " * 20_000, "en", "b"), (6, "§§ 12 ++", "de", "")]
SCHEMA = "doc_id long, text string, lang string, source string, simhash string, size string, k string, rank string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "s", "t", "u", "v") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_edge_cases(spark, odd, none):
    for docs, n in ((odd, len(ODD)), (none, 0)):
        marks = labels(spark, [(2, 1, 0), (4, 1, 1), (None, 1, 1)])
        scores = lm_scoring.cross_entropy_difference(docs, marks.select("doc_id")).collect()
        assert len(scores) == n and all(r["difference"] == 0 for r in scores if r["doc_id"] in (1, 2, 3))
        tox = toxicity.score_toxicity(docs, marks, F.lit(True)).collect()
        assert len(tox) == n and all(0 <= r["toxicity"] <= 1 for r in tox)
        lang = language_id.identify(docs, F.lit(True)).collect()
        assert len(lang) == n and all(r["lang_pred"] == "und" for r in lang if r["doc_id"] in (1, 2, 3, 6))
        near = simhash.near_duplicates(docs).collect()
        assert len(near) == n and {r["component_id"] for r in near if r["doc_id"] in (1, 2, 3)} <= {1}
        shards = sharding.shard_by_bytes(docs, 3).collect()
        assert sum(r["size"] for r in shards) == sum(len((r[1] or "").encode()) + 1 for r in ODD) * bool(n)
        for s in {r["shard"] for r in shards}:
            slots = [r["slot"] for r in shards if r["shard"] == s]
            assert sorted(slots) == list(range(len(slots)))
        assert mixing.copies(docs).count() == n and mixing.mixed(docs).columns == docs.columns
        assert packing.pack(docs, PATH, PATTERN).select("doc_id", "piece").distinct().count() == (len({r[0] for r in ODD}) + math.ceil((len(Tokens().ids(ODD[6][1])) + 1) / 1024) - 1) * bool(n)


class Tokens:
    def __init__(self):
        self.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def ids(self, text):
        return self.t.encode(text or "", add_special_tokens=False).ids


def test_tokens_equal_the_tokenizer():
    special = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    rng, ours, theirs = random.Random(5), packing.Tokens(PATH, PATTERN, special), Tokens()
    assert np.frombuffer(ours.ids("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    alphabet = ["a", "Word", "'s", " ", "  ", "\n", "\n\n", "\t", " ", " ", "é", "ß.", "12", "!!", "<|endoftext|>", "<|endof", "日本", "🙂", "\r\n", "don't"]
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randrange(12)))
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == theirs.ids(text), repr(text)


def test_packing_is_whole_and_tight(spark):
    docs, theirs = table(spark, DIR, "documents"), Tokens()
    rows = queries.op10_packing(spark, DIR).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for d in docs.collect():
        ids = np.array([*theirs.ids(d["text"]), 2], "<u4")
        own = sorted(by_doc.pop(d["doc_id"]), key=lambda r: r["piece"])
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 1024 for r in own[1:])
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
        total += len(ids)
    assert not by_doc
    for own in by_bin.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1] and sum(r["length"] for r in own) <= 1024
    assert len(by_bin) <= math.ceil(total / 1024) + 2


def test_fullest_against_all_subsets():
    rng = random.Random(6)
    for _ in range(60):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(1, 60)
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        chosen = packing.fullest({x: items.count(x) for x in items}, room)
        assert sum(chosen) == best and all(chosen.count(x) <= items.count(x) for x in chosen)


def test_fingerprint_by_definition():
    for text in ("A b c d", "one", "Été x\x0by z\n w", "a a a a a", "  q"):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_covering_links_against_all_pairs(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(12)})
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(prints, 2):
        if bin(a ^ b).count("1") <= radius:
            x, y = find(a), find(b)
            root[max(x, y, key=signed.get)] = min(x, y, key=signed.get)
    edges = simhash.linked_prints(spark.createDataFrame([(signed[p],) for p in prints], "simhash long"), radius)
    got = {r["node"]: r["root"] for r in components.components(edges, "left", "right").collect()}
    assert {signed[p]: got.get(signed[p], signed[p]) for p in prints} == {signed[p]: min(signed[q] for q in prints if find(q) == find(p)) for p in prints}


def test_components_of_a_chain(spark):
    ids = random.Random(7).sample(range(1000), 60)
    edges = spark.createDataFrame(list(itertools.pairwise(ids)) + [(5000, 5001)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges, "a", "b").collect()}
    assert all(got[i] == min(ids) for i in ids) and got[5001] == 5000


def test_shards_are_balanced_and_contiguous(spark):
    docs = table(spark, DIR, "documents")
    rows = sorted(sharding.shard_by_bytes(docs, 8).collect(), key=lambda r: r["doc_id"])
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)


def test_shards_with_one_hot_key(spark):
    docs = spark.createDataFrame([(7 if i % 3 else i, "x" * (i % 50)) for i in range(3000)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(docs, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(rows) == 8 and max(r["b"] for r in rows) - min(r["b"] for r in rows) <= 100


def test_targets_by_iteration(spark):
    sizes = {"a": 10, "b": 1000, "c": 10, "d": 500, None: 1}
    got = {r["src"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    want, open_, left = {}, set(sizes), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            want |= share
            break
        for s in above:
            want[s] = 3 * sizes[s]
            left -= want[s]
        open_ -= above
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9) for s in sizes)


def test_mix_comes_near_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 40), f"s{i % 3}") for i in range(6000)], "doc_id long, text string, source string")
    rows = mixing.copies(docs, keep=["doc_id", "source"]).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    assert all(abs(r["n"] / r["t"] - 1) < 0.1 for r in rows)
    assert mixing.mixed(docs).count() == mixing.copies(docs).agg(F.sum("copies")).first()[0]


def vectors(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]))


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.3])).astype(np.float32).tolist(), i % 2 if i % 11 else None) for i in range(400)]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [1.0, None], 0), (404, [], 1), (405, [1.0, 2.0], 0), (406, [2.0, 4.0], 0), (406, [2.0, 4.0], 0)]
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, near = {}, {}
    for (i, a, x), (j, b, y) in itertools.combinations(good, 2):
        if x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
            for p, q in ((i, j), (j, i)):
                links[p] = links.get(p, 0) + 1
                near.setdefault(p, set()).add(q)
    got = embedding_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] != 406:
            assert r["n_links"] == links.get(r["vec_id"], 0)
        seen, todo = {r["vec_id"]}, [r["vec_id"]]
        while todo:
            fresh = near.get(todo.pop(), set()) - seen
            seen |= fresh
            todo += fresh
        assert r["component_id"] == min(seen) and r["kept"] == (r["vec_id"] == min(seen))
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0


def test_neighbours_recall_and_order(spark):
    vecs = table(spark, DIR, "embeddings")
    rows = vecs.collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in ann.search(vecs, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = 0
    for q in ids[ids % 20 == 0]:
        s = v @ v[ids == q][0]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(math.isclose(m[2], s[ids == m[1]][0]) for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine) and q not in [m[1] for m in mine]
        found += len({m[1] for m in mine} & set([i for i in ids[np.lexsort((ids, -s))] if i != q][:20]))
    assert found / (20 * len(got)) >= 0.9


def test_neighbours_ties_and_few(spark):
    rows = [(i, [1.0, 1.0], 0) for i in range(50)] + [(50, None, 0), (51, [0.0, 0.0], 0), (52, [float("inf"), 1.0], 0)]
    got = ann.search(vectors(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 21))
    assert ann.search(vectors(spark, rows[:3]), F.col("vec_id") == 0).count() == 2
    assert ann.search(vectors(spark, []), F.lit(True)).count() == 0


def test_toxicity_on_held_out_rows_and_misspellings():
    rng = random.Random(9)
    syllables = ["ba", "ne", "ti", "ro", "lu", "ka", "mo", "si"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    make = lambda bad: " ".join([rng.choice(["blorptagger", "zwinkler"]) if bad and i % 9 == 0 else word() for i in range(rng.randrange(5, 120))])
    y = np.array([i % 4 == 0 for i in range(800)], int)
    model = toxicity.train([make(b) for b in y], y, 0.25)
    import pyarrow as pa

    held = [make(i % 4 == 0) for i in range(200)]
    assert (((model.scores(pa.array(held)) >= 0.5) == (np.arange(200) % 4 == 0)).mean()) > 0.97
    near, far = model.word_margins(["blorptager", "banero"])[0]
    assert near > far + 10


def test_toxicity_sample_passes_over_long_texts(spark, monkeypatch):
    """A very long text, or a budget that runs out, loses neither the other texts nor a class."""
    monkeypatch.setattr(toxicity, "MOST_CHARS", 60_000)
    rows = [(0, "long words " * 20_000)] + [(i, f"common words here and there {'blorptagger zwinkler ' * 2 if i % 3 == 0 else 'quiet '}") for i in range(1, 121)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = labels(spark, [(i, 0, int(i % 3 == 0 and i > 0)) for i, _ in rows])
    model = toxicity.fit(docs, marks)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.scored(docs, model).collect()}
    assert sum((got[i] >= 0.5) == (i % 3 == 0) for i in range(1, 121)) > 110
    sizes = spark.createDataFrame([(i, 1, 10 if i % 2 else 45, i) for i in range(40)], "id long, y int, size int, print long")
    order = [(r["id"], r["size"]) for r in sizes.orderBy(F.xxhash64("id", F.lit(4))).collect()]
    want, left = [], 100
    for i, n in order:
        if n <= left and len(want) < 7:
            want.append((i, i))
            left -= n
    assert toxicity.sample(sizes, 1, 7, 100, 4) == want


def test_language_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.95


def test_language_models_against_vectors():
    texts = ["abc abd", "", "ça va"]
    for text, got in zip(texts, language_id.bundled(texts), strict=True):
        want = np.zeros(language_id.WIDTH)
        padded = f" {text} " if text else " "
        for g in (padded[i : i + 3] for i in range(len(padded) - 2)):
            want += np.prod([np.roll(language_id.letter(ord(c)).astype(int), 2 - k) for k, c in enumerate(g)], axis=0)
        assert np.array_equal(got, want)


def test_losses_against_counts(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a c"), (3, "b a"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs, spark.createDataFrame([(1,), (3,)], "doc_id long")).collect()}
    corpus = {1: "abab", 2: "ac", 3: "ba"}

    def chance(v, w, rest, scale):
        words = [x for d in rest for x in d]
        alone = (scale * words.count(w) + 0.1) / (scale * len(words) + 0.1 * 3)
        pair = sum(("^" + d)[k : k + 2] == v + w for d in rest for k in range(len(d)))
        context = sum(("^" + d)[k] == v for d in rest for k in range(len(d)))
        return (scale * pair + 8 * alone) / (scale * context + 8)

    def loss(doc, rest, scale=1.0):
        assert all(math.isclose(sum(chance(v, w, rest, scale) for w in "abc"), 1) for v in "^abc")
        return -sum(math.log(chance(doc[i - 1] if i else "^", w, rest, scale)) for i, w in enumerate(doc)) / len(doc)

    for i, d in corpus.items():
        assert math.isclose(got[i]["target_loss"], loss(d, [corpus[j] for j in (1, 3) if j != i], 8 / 6), rel_tol=1e-5)
        assert math.isclose(got[i]["background_loss"], loss(d, [corpus[j] for j in corpus if j != i]), rel_tol=1e-5)
    assert got[4]["n_words"] == 0 and got[4]["difference"] == 0


def test_losses_do_not_depend_on_how_targets_are_joined(spark, monkeypatch):
    docs, good = table(spark, DIR, "documents"), table(spark, DIR, "labels").filter("quality = 1").select("doc_id")
    few = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs, good).collect()}
    monkeypatch.setattr(lm_scoring, "BROADCAST_KEYS", 0)
    many = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs, good).collect()}
    assert few.keys() == many.keys() and all(math.isclose(few[i][c], many[i][c], rel_tol=1e-9, abs_tol=1e-12) for i in few for c in ("target_loss", "background_loss", "difference"))


def test_losses_with_a_word_in_every_slice(spark, monkeypatch):
    """Slices added up in groups first give the same counts, however few slices a group and n-grams a bucket has."""
    rng = random.Random(6)
    rows = [(i if i % 9 else None, " ".join(["the", *(rng.choice(["the", "a", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(30)))])) for i in range(400)]
    docs, good = spark.createDataFrame(rows, "doc_id long, text string").repartition(40), spark.createDataFrame([(i,) for i in range(0, 400, 3)], "doc_id long")
    told = lambda: sorted(tuple(round(x, 9) if isinstance(x, float) else -1 if x is None else x for x in r) for r in lm_scoring.cross_entropy_difference(docs, good).collect())
    plain = told()
    monkeypatch.setattr(lm_scoring, "SPREAD", 3)
    monkeypatch.setattr(lm_scoring, "BUCKET", 400)
    assert told() == plain and len(plain) == 400


def test_losses_of_more_words_than_slots(spark):
    """Words and pairs of a vocabulary beyond any fixed table are counted apart."""
    many = [f"w{i}" for i in range(100_000)]
    rows = [(i, " ".join(many[i * 1000 : (i + 1) * 1000])) for i in range(100)] + [(200, "new0 new1 new2"), (201, "w5 w6"), (202, "w6 w5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs, spark.createDataFrame([(0,)], "doc_id long")).collect()}
    spread, n = 0.1 * 100_003, 100_000 + 3 + 2 + 2

    def loss(n, *seen, scale=1.0):  # (pair, word, context) of each word, without the document's own
        return -sum(math.log((scale * p + 8 * (scale * w + 0.1) / (scale * n + spread)) / (scale * c + 8)) for p, w, c in seen) / len(seen)

    assert math.isclose(got[200]["background_loss"], loss(n - 3, (0, 0, 102), (0, 0, 0), (0, 0, 0)), rel_tol=1e-9)
    assert math.isclose(got[201]["background_loss"], loss(n - 2, (0, 2, 102), (1, 2, 1)), rel_tol=1e-9)
    assert math.isclose(got[201]["target_loss"], loss(1000, (0, 1, 1), (1, 1, 1), scale=n / 1000), rel_tol=1e-9)
    assert math.isclose(got[202]["target_loss"], loss(1000, (0, 1, 1), (0, 1, 1), scale=n / 1000), rel_tol=1e-9)


PAGE = '<html><head><title>T</title></head><body><div class="top menu">m</div><div class="wrap"><h1>Head &lt;{0}</h1><p>One {0} <b>two</b><p>Three<br>{0}</div><div class="sidebar">s</div><div id="comments"><p>c {0}</p></div><form>f</form><footer>x</footer></body></html>'


def test_wrappers(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(f"word{i}")) for i in range(5)] + [(9, None, None), (10, "http://h.example/x", ""), (10, "http://h.example/x", ""), (11, "http://o.example/", "<article><h1>A</h1><p>b &amp; c</article>tail")]
    got = {r["page_id"]: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i]["text"] == f"Head <word{i}\nOne word{i} two\nThree word{i}" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[9]["text"] == got[10]["text"] == "" and got[11]["text"] == "A\nb & c"


def test_wrappers_of_chrome_words():
    text = lambda page: html_extract.Extractor(html_extract.infer([page, page]), 2).text(page)
    assert text('<body class="single no-sidebar"><article><p>a</p></article></body>') == "a"
    assert text('<body class="sidebar"><main class="comments"><p>a</p></main></body>') == "a"
    assert text('<body><h1>t</h1><div class="content ad-free"><p>a</p></div><div class="ad"><p>x</p></div></body>') == "t\na"
    assert text('<body><div class="widget"><p>a</p></div><nav>n</nav></body>') == "a"
    assert text('<div class="overlay"><div class="popup"><article><p>a</p></article></div><div class="ad">x</div></div>') == "a"
    assert text('<article><p>a</p></article><div class="comments"><article>c</article></div>') == "a"
    assert text('<article>a<svg class="i" /><p>b</p></article>') == text('<article>a<svg><path/></svg><p>b</p></article>') == "a\nb"
    for end in ("AT&T", "a &amp; b &", "R&D", "x &amp", "Johnson &Johnson"):
        assert text(f"<p>{end}") == end.replace("&amp", "&").replace("&;", "&")
    assert text("<p>caf&eacut") == "caf" and text("<p>x&#82") == "x"


LAYOUTS = [
    # No class or element tells; the advert and the notes differ from page to page.
    '<body><div class="x1"><ul><li><a href="/{n}">{m}</a></li><li><a href="/b">Shop</a></li></ul></div><div class="x2"><h1>{h}</h1>{body}</div><div class="x3"><p>Sign up {m} today</p></div><div class="x4">All rights reserved</div></body>',
    # Class words mislead.
    '<body class="no-sidebar home"><div class="has-comments with-sidebar"><div class="related-work"><h1>{h}</h1>{body}</div></div><div class="q">{m} {m}</div><div class="z">Terms and privacy</div></body>',
    '<body><div class="widget"><h2>{h}</h2>{body}</div><div class="sidebar"><p>{m} and {n}</p></div></body>',
    # The host's own lines stand inside the article.
    '<main class="comments"><nav>{m}</nav><article class="post has-comments"><header><h1>{h}</h1></header><div class="by">Written by our staff</div>{body}<div class="tools">Print this page</div><aside>{m}</aside></article><section class="comment-list"><p>{m} said {m}</p></section></main>',
    # A layout by tables, a heading beside the text, unclosed tags.
    '<table><tr><td><a href=1>{m}</a> | <a href=2>Home</a><td><h1>{h}</h1>{body}<td>{m} fair<tr><td>Imprint</table>',
    '<div role="banner">{m}</div><h1>{h}</h1><div class="cookie-notice">{m}</div><div id="c">{body}</div><div role="contentinfo">{m}</div><script>var a = "<p>{m}</p>";</script><form><p>{m}</p></form>',
]


def made_page(layout, rng):
    """(page, its article's text)."""
    word = lambda: "".join(rng.choices("abcdefgh&<é", k=rng.randrange(1, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    head, body, text = line(4), [], []
    for _ in range(rng.randrange(2, 7)):
        a, b = line(rng.randrange(6, 40)), line(3)
        kind = rng.randrange(4)
        esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace("é", "&eacute;")
        if kind == 0:
            body.append(f"<ul><li>{esc(a)}</li>\n<li><b>{esc(b)}</b></li></ul>")
            text += [a, b]
        elif kind == 1:
            body.append(f"<blockquote>{esc(a)}<p>{esc(b)}</p></blockquote>")
            text += [a, b]
        else:
            body.append(f"<p>{esc(a)}  <a href='x'>{esc(b)}</a>\n &amp; so</p>")
            text.append(f"{a} {b} & so")
    page = layout.format(h=head.replace("&", "&amp;").replace("<", "&lt;"), body="".join(body), m=line(2).replace("&", "").replace("<", ""), n=rng.randrange(99))
    return page, "\n".join([head, *text])


@pytest.mark.parametrize("layout", range(len(LAYOUTS)))
def test_wrappers_give_back_known_articles(spark, layout):
    """Pages made around known articles give those articles back, exactly; without the wrapper they do not."""
    rng = random.Random(layout)
    made = [made_page(LAYOUTS[layout], rng) for _ in range(40)]
    rows = [(i, f"https://host{layout}.example/{i}", p, "extra", "extra") for i, (p, _) in enumerate(made)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")
    got = {r["page_id"]: r for r in html_extract.main_text(pages).collect()}
    assert [got[i]["text"] for i in range(40)] == [t for _, t in made] and all(r["n_chars"] == len(r["text"]) for r in got.values())
    bare = html_extract.Extractor(None)
    assert sum(bare.text(p) != t for p, t in made) > 30


def test_the_wrapper_decides(spark):
    """On nearly every page of the tables the text depends on the wrapper."""
    pages = table(spark, DIR, "pages").collect()
    got = {r["page_id"]: r["text"] for r in queries.op5_html_extraction(spark, DIR).collect()}
    bare = html_extract.Extractor(None)
    assert len(got) == len(pages) and sum(bare.text(r["html"]) != got[r["page_id"]] for r in pages) > 0.9 * len(pages)


def test_html_edge_cases(spark):
    """Very long and hot hosts, repeated rows, nulls in every column, an empty table, clashing columns."""
    schema = "page_id long, url string, html string, text string, n_chars string, wrapper string, h long"
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(30_000)) + "</article>"
    rows = [(None, None, None), (1, None, "<p>x</p>"), (2, "no url", ""), (3, "http://hot.example/", long), (3, "http://hot.example/", long)]
    rows += [(i, "http://hot.example/", f"<nav>n</nav><article><p>text {i}</p></article>") for i in range(10, 200)]
    pages = spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], schema)
    got = html_extract.main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = {r["page_id"]: r["text"] for r in got.collect()}
    assert texts[None] == texts[2] == "" and texts[1] == "x" and texts[3].count("\n") == 29_999 and all(texts[i] == f"text {i}" for i in range(10, 200))
    assert got.count() == len(rows) and html_extract.main_text(pages.limit(0)).count() == 0


def test_alignment_of_long_sequences():
    a = [(f"k{i}", frozenset()) for i in range(3000)]
    b = [k for i, k in enumerate(a) if i % 7] + [("z", frozenset())] * 500
    pairs = html_extract.common(a, b)
    assert len(pairs) == len([k for i, k in enumerate(a) if i % 7]) and all(a[i] == b[j] for i, j in pairs)
    assert all(p < q and r < s for (p, r), (q, s) in itertools.pairwise(pairs))


def test_deep_nesting():
    deep = "<div>" * 5000 + "<p>in</p>" + "</div>" * 5000
    page = f"<body><nav>{'<div>' * 3000}m{'</div>' * 3000}</nav><article>{deep}<p>after</p></article><footer>f</footer></body>"
    assert html_extract.Extractor(html_extract.infer([page, page]), 2).text(page) == "in\nafter"


def test_alignment_makes_slots_options_and_repeats():
    made = html_extract.infer(["<ul><li>a</li></ul><p>x</p>", "<ul><li>b</li><li>c</li></ul><hr><p>x</p>"])
    assert made == [["ul", False, False, [["li", False, True, [["#", False, False, None]]]]], ["hr", True, False, []], ["p", False, False, [["#", False, False, "x"]]]]


def shingle_sets(texts, n=5):
    out = {}
    for i, text in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        out[i] = frozenset(b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    return out


def close_pairs(sets, least=0.8):
    """All pairs of a Jaccard similarity of ``least`` or more, by comparing all with all; empty sets are alike."""
    ids = sorted(sets)
    return {(i, j) for i, j in itertools.combinations(ids, 2) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}


def roots_of(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in sorted(pairs):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def edited(text, rng, share):
    words = text.split()
    for k in rng.sample(range(len(words)), max(1, int(share * len(words)))):
        words[k] = rng.choice("uvwxyz") * rng.randrange(3, 9)
    return " ".join(words)


def test_similar_texts_against_all_pairs(spark):
    """Every link that is made is right, and nearly all that there are are made, in a hot group and in small ones."""
    rng = random.Random(10)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(rng.randrange(60, 300)))
    texts = [line() for _ in range(120)] + [None, "", " \t", "one", "ONE", "two words"]
    hot = line()
    texts += [edited(hot, rng, rng.choice([0.005, 0.01, 0.02, 0.04, 0.08])) for _ in range(150)] + [hot] * 20
    texts += [edited(t, rng, rng.choice([0.01, 0.02, 0.03, 0.05])) for t in texts[:60] for _ in range(2)]
    shared = line()
    texts += [f"{line()} {shared}" for _ in range(40)]
    texts = dict(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in texts.items()], "doc_id long, text string, digest string, simhash int").repartition(7)
    got = {r["doc_id"]: r["component"]["doc_id"] for r in simhash.similar_texts(docs).collect()}
    want = roots_of(texts, close_pairs(shingle_sets(texts)))
    assert got.keys() == want.keys() and roots_of(texts, {(i, r) for i, r in got.items() if i != r}.union((i, r) for i, r in want.items() if i != r)) == want
    joined = [got[i] == got[j] for i, j in close_pairs(shingle_sets(texts))]
    assert sum(joined) / len(joined) > 0.99
    assert simhash.similar_texts(docs.limit(0)).count() == 0


def test_similar_texts_that_no_sketch_brings_together(spark):
    """Pairs of a similarity of 0.8 that share no block of their sketches, among texts that share a passage."""
    rng = random.Random(11)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    passage, texts = line(30), []
    while len(texts) < 12:
        one = line(200)
        other = edited(one, rng, 0.02)
        both = [np.unique(simhash.shingle_hashes(x)[0]) for x in (one, other)]
        shared = len(np.intersect1d(*both))
        a, b = (simhash.sketch(x).reshape(-1, simhash.BLOCK) for x in both)
        if shared >= 0.8 * (len(both[0]) + len(both[1]) - shared) and not (a == b).all(axis=1).any():
            texts += [one, other]
    texts = dict(enumerate([*texts, *[f"{passage} {line(20)}" for _ in range(30)], "a b", "a b c", None]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component"]["doc_id"] for r in simhash.similar_texts(docs).collect()}
    assert got == roots_of(texts, close_pairs(shingle_sets(texts)))


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    frequent = (np.arange(0, 400, 7, dtype=np.uint64), rng.integers(1, 9, 58).astype(np.int8))
    for _ in range(2000):
        base = rng.choice(400, rng.integers(1, 60), replace=False).astype(np.uint64)
        a, b = (np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 400, len(base)).astype(np.uint64), base)) for _ in range(2))
        shared = len(np.intersect1d(a, b))
        if shared >= 0.8 * (len(a) + len(b) - shared):
            met = len(np.intersect1d(simhash.prefix(a, 0.8, frequent), simhash.prefix(b, 0.8, frequent)))
            assert met >= min(simhash.SHARED, np.ceil(0.8 * min(len(a), len(b)) - 1e-6))


def test_pairs_whose_marks_differ_are_not_listed(spark):
    """Short texts that share a passage have prefixes that meet, and are no pairs; a similar pair among them is."""
    rng = random.Random(12)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    passage = line(40)
    texts = [f"{passage} {line(40)}" for _ in range(60)]
    texts.append(f"{texts[7]} more")
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string").withColumn("print", F.xxhash64("text"))
    classes = rows.select(F.encode("text", "utf-8").alias("digest"), "print")
    found = simhash._missed(rows, classes, classes.select("digest", F.col("digest").alias("root")), 5, 0.8).collect()
    assert [sorted(bytes(x).decode() for x in r) for r in found] == [sorted([texts[7], texts[60]])]


def test_marks_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(4)
    for _ in range(500):
        base = rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64)
        a, b = (np.unique(np.where(rng.random(len(base)) < 0.1, rng.integers(0, 1 << 63, len(base)).astype(np.uint64), base)) for _ in range(2))
        bits = np.unpackbits((simhash.mark(a) ^ simhash.mark(b)).view(np.uint8)).sum()
        assert bits <= len(np.setxor1d(a, b)) and simhash.mark(a).shape == (simhash.MARKS,)


def test_pipeline_sends_small_batches_to_python(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(name), table(spark, DIR, "documents")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": [batch.num_rows]})

    try:
        for step, stage in corpus_pipeline.STAGES:
            if step != "source_mixing":
                spark.conf.set(name, "10000")
                stage(spark, docs, DIR)
                assert max(r["id"] for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "id long").collect()) <= corpus_pipeline.BATCH_ROWS, step
        spark.conf.set(name, "7")
        corpus_pipeline.drop_near_duplicates(spark, docs, DIR)
        assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)


def test_pipeline_near_duplicates_on_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    where = "/root/testdata/sf0.01"
    docs = table(spark, where, "documents")
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, where).collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    root = roots_of(texts, close_pairs(shingle_sets(texts)))
    least = set(root.values())
    assert len(kept) == len(set(kept)) and least <= set(kept)
    assert len(set(kept) - least) <= 0.05 * (len(texts) - len(least))


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, none):
    """Nulls in every column, repeated rows, repeated ids with other texts, clashing columns: rows and columns of every stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    clash = odd.withColumns({c: F.lit("x") for c in ("print", "component", "toxicity", "__toxicity", "copies", "digest", "__id", "__often")})
    for docs, n in ((clash, len(ODD)), (clash.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DIR)
            assert out.columns == docs.columns, name
            rows = sorted(map(str, out.collect()))
            assert len(rows) <= 3 * n and set(rows) <= set(map(str, docs.collect())), name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
        assert packed.select("doc_id").distinct().count() == len({r[0] for r in ODD}) * bool(n)
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, clash, DIR).collect()]
    assert sorted(map(str, kept)) == ["1", "4", "5", "6", "None"]
    rows = [(3, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "q r s t u v w x"), (6, "q r s t u v w x"), (6, "q r s t u v w x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, DIR).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [rows[0], rows[2]]


def test_pipeline_against_its_parts(spark):
    """Each stage, on what the one before kept, does what its operator says."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, DIR, "documents")
    docs = docs.unionByName(docs.filter("doc_id < 3"))
    model = toxicity.fit(docs, table(spark, DIR, "labels"))
    toxic = [r["doc_id"] for r in toxicity.scored(docs, model).filter("toxicity >= 0.5").collect()]
    kept = corpus_pipeline.drop_toxic(spark, docs, DIR)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in toxic)
    langs = {r["doc_id"]: r for r in language_id.identify(docs, F.lit(True)).collect()}
    kept = corpus_pipeline.drop_unknown_language(spark, docs, DIR)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in langs.items() if r["lang_pred"] != "und" and r["lang_score"] >= 0.1}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, DIR)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots_of(texts, close_pairs(shingle_sets(texts))).values()))
    times = {r["doc_id"]: r["copies"] for r in mixing.copies(kept).collect()}
    mixed = [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, kept, DIR).collect()]
    assert all(mixed.count(i) == n for i, n in times.items())
    packed = corpus_pipeline.pack_sequences(spark, kept, DIR)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert corpus_pipeline.run(spark, DIR).count() > 0
