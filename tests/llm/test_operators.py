"""The operators of terrane.llm against brute force on small tables with nulls, ties, copies, long texts and odd columns."""

import hashlib
import os
import random
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from terrane.llm import chat, langid, lm_scoring, mixing, ngram_join, piece, sharding, suffix_dedup, syncmers, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, kind string, tid string, n string"


def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Été", "x", "of", "the", "and", "zeta9"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))
    base, passage = prose(120), prose(70)
    near = base.split()
    near[60] = "changed"
    made = [base, base, " ".join(near), base.upper(), "", None, " \n\t ", "one", "two words", prose(3000), prose(40) + " " + passage]
    made += [passage + "\n" + prose(30), "aé" * 500, "日本語" * 10, "1234 5678", prose(90) + passage + prose(50), passage[:399], passage[1:]]
    return made


@pytest.fixture(scope="module")
def rows():
    sources = ["a", None, "b", "a", "a"]
    found = [(i, t, "en" if i % 3 else None, sources[i % 5], 0, "q", "q", "q", "q") for i, t in enumerate(texts())]
    return found + [found[0], (100, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding_is_a_reproducible_permutation(docs, nothing, rows):
    found = sharding.shard_rows(docs, ["doc_id"], shards=4).collect()
    n = len(rows)
    assert sorted(r["row_number"] for r in found) == list(range(n)) == sorted(r["position"] for r in found)
    assert all((r["shard"], r["slot"]) == (r["position"] % 4, r["position"] // 4) for r in found)
    again = sharding.shard_rows(docs.repartition(7), ["doc_id"], shards=4).collect()
    key = lambda r: (str(r["doc_id"]), r["position"])
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert sharding.shard_rows(nothing, ["doc_id"]).count() == 0
    odd = docs.select("doc_id", F.lit("x").alias("slot"), F.lit(1).alias("Shard"))
    assert sorted(sharding.shard_rows(odd, ["doc_id"]).columns) == ["doc_id", "position", "row_number", "shard", "slot"]


@pytest.mark.parametrize("rows_", [1, 2, 3, 10, 97, 1000])
def test_cycle_walking_stays_a_bijection(spark, rows_):
    placed = spark.range(rows_).selectExpr(sharding.permuted("id", rows_, 3) + " as p")
    assert sorted(r["p"] for r in placed.collect()) == list(range(rows_))


def test_pieces_match_the_library(docs, nothing, rows):
    path = public_tokenizers.path("piece_bpe_32k.model")
    held = sentencepiece.SentencePieceProcessor(model_file=path)
    model = piece.read_model(path)
    for r in piece.encode(docs, model).collect():
        ids = held.encode(r["text"] or "")
        assert (r["n_tokens"], r["ids"], r["decoded"]) == (len(ids), ",".join(map(str, ids)), held.decode(ids))
    assert piece.digests(nothing, model).count() == 0
    own, rng = piece.Pieces(model), random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("aeitnos .,\n▁<>é日😀01-_\t!?s") for _ in range(rng.randrange(30)))
        ids = held.encode(text)
        assert own.whole(text) == (len(ids), ",".join(map(str, ids)), held.decode(ids))
        assert own.decode(ids) == held.decode(ids)


def test_mixing_meets_its_target(docs, nothing, rows):
    found = mixing.mix(docs, value=2.0).collect()
    seen = Counter((r["source"], r["block"], r["order_key"], r["doc_id"]) for r in found)
    for r in rows:  # every row stays, copies as often as they come
        assert sum(n for (_, block, _, d), n in seen.items() if d == r[0] and block == 0) == sum(x[0] == r[0] for x in rows)
    tokens, share = Counter(), Counter()
    for r in found:
        share[r["source"]] += r["n_tokens"]
        tokens[r["source"]] += r["n_tokens"] if r["block"] == 0 else 0
    repeats = [share[s] / tokens[s] for s in tokens]
    assert max(repeats) <= 2.0 + 1e-6 and min(repeats) >= 1
    assert mixing.mix(nothing).count() == 0


def test_entropy_is_bisected(spark):
    import math

    got = spark.range(1).selectExpr(mixing.exponent("array(0.7D, 0.2D, 0.1D)", "entropy", 1.0) + " as e").first()["e"]
    w = [p**got for p in (0.7, 0.2, 0.1)]
    assert abs(-sum(x / sum(w) * math.log(x / sum(w)) for x in w) - 1.0) < 1e-6


def removed(pairs, length):
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in pairs]
    for _, b in raw:
        seen.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("part_rows", [2, 2_048])
def test_repeats_match_brute_force(docs, nothing, rows, monkeypatch, part_rows):
    monkeypatch.setattr(suffix_dedup, "PART_ROWS", part_rows)
    for length in (256, 400):
        found = suffix_dedup.spans_removed(docs, length=length).collect()
        assert sorted(map(tuple, found)) == removed([(r[0], r[1]) for r in rows], length)
    assert suffix_dedup.spans_removed(nothing).count() == 0
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_tables_on_the_way_are_deleted(spark, docs, rows, monkeypatch, tmp_path):
    import corpus_pipeline
    from terrane.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path / uuid.uuid4().hex))
    for words in (None, 51):
        before = set(os.listdir(tmp_path))
        suffix_dedup.texts_cleaned(docs, words=words)
        assert len(set(os.listdir(tmp_path)) - before) <= 3  # the result and the lists of large groups
    held = docs.select("doc_id", "text", "lang", "source", "n_chars")
    before = set(os.listdir(tmp_path))
    kept = corpus_pipeline.ngram_jaccard(spark, held, "")
    assert kept.count() < len(rows)
    left = [spark.read.parquet(str(tmp_path / d)) for d in set(os.listdir(tmp_path)) - before]
    assert not {"text", "__text", "signature", "grams"} & {c for t in left for c in t.columns}


def test_groups_of_starts_may_be_compared_one_by_one(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COMPARED", 1)
    monkeypatch.setattr(suffix_dedup, "PART_ROWS", 3)
    found = suffix_dedup.spans_removed(docs, length=256).collect()
    assert sorted(map(tuple, found)) == removed([(r[0], r[1]) for r in rows], 256)


def test_starts_of_a_text_take_one_hash_whatever_its_anchors(spark, monkeypatch):
    # A worker counts how often the starts are hashed: twice for the pairs of ranks, once for all starts of the text.
    text = " ".join(f"word{i * i}" for i in range(800))
    anchor, low, high, *_ = suffix_dedup._pairs(np.frombuffer(text.encode(), dtype=np.uint8), 400)
    held = spark.createDataFrame([(5, text, [(int(a), 2) for a in anchor[::-1]])], "tid long, text string, left array<struct<anchor:long,parts:long>>")
    calls = spark.sparkContext.accumulator(0)
    plain = suffix_dedup._hash

    def counted(*args):
        calls.add(1)
        return plain(*args)

    monkeypatch.setattr(suffix_dedup, "_hash", counted)
    got = suffix_dedup._starts(held, 400).collect()
    assert len(anchor) > 20 and sorted((r["anchor"], r["low"], len(r["packed"])) for r in got) == sorted(
        (int(a), int(x), 6 * int(y - x + 1)) for a, x, y in zip(anchor, low, high, strict=True)
    )
    assert all(r["part"] == (5 ^ r["anchor"]) % 2 and r["parts"] == 2 for r in got)
    assert calls.value <= 3


def grouped(rows):
    sets = []
    for i, text in rows:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        sets.append((i, {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()))
    root = {i: i for i, _ in sets}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return sorted((i, len(s), root[i]) for i, s in sets)


@pytest.mark.parametrize("split", [2, 4_096])
def test_near_copies_match_brute_force(spark, docs, nothing, rows, monkeypatch, split):
    monkeypatch.setattr(ngram_join, "SPLIT_ROWS", split)
    found = ngram_join.join(docs).collect()
    assert sorted(map(tuple, found)) == grouped([(r[0], r[1]) for r in rows])
    assert ngram_join.join(nothing).count() == 0
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    chain = []
    for i in range(60):
        base[rng.randrange(80)] = f"c{i}"
        chain.append((i, " ".join(base)))
    found = ngram_join.join(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == grouped(chain)


def test_tiles_of_the_same_classes_are_opened_once(spark):
    rows = [(tile, kind, 10) for tile in (1, 2) for kind in (7, 8, 9)] + [(3, kind, 10) for kind in (7, 8, 10)]
    found = spark.createDataFrame([], "kind long, label long")
    got = ngram_join._open_rows(spark.createDataFrame(rows, "tile long, kind long, n long"), found).collect()
    assert sorted((r["tile"], r["kind"]) for r in got) == [(1, 7), (1, 8), (1, 9), (3, 7), (3, 8), (3, 10)]


def test_common_ngrams_are_found_on_a_share_of_the_documents(spark, monkeypatch):
    # A sample of 100 has 2 of the 60 documents with the passage, one of a twelfth some 5; its n-grams then make no tile.
    monkeypatch.setattr(ngram_join, "SAMPLE", 100)
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = prose(8)
    rows = [(i, f"{prose(40)} {passage if i % 50 == 0 else prose(8)} {prose(10)}") for i in range(3_000)]
    texts = spark.createDataFrame(rows, "__key long, __text string").repartition(2)
    described = ngram_join._described(texts, 5, 80, ngram_join._common(texts, 5))
    assert ngram_join._tiles(described, 80).count() == 0


def test_prefixes_end_with_the_commonest_ngrams():
    held = np.array([2, 3, 5, 7, 11], dtype=np.uint64)
    common, often = np.array([2, 5, 6, 11], dtype=np.uint64), np.array([9, 3, 50, 4], dtype=np.int32)
    assert ngram_join.ordered(held, common, often).tolist() == [3, 7, 5, 11, 2]
    assert ngram_join.ordered(held, common[:0], often[:0]).tolist() == held.tolist()


@pytest.mark.parametrize("sent", [0, 1_000])
def test_few_classes_are_sent_to_the_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(ngram_join, "SENT_ROWS", sent)
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "__key long, __text string")
    classes = spark.createDataFrame([(i + 100, i) for i in range(6)], "kind long, first long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = ngram_join._chosen(spark.createDataFrame([(102,), (105,)], "kind long"), classes, texts)
        assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == (sent > 0)
        assert sorted(map(tuple, found.collect())) == [(102, "text 2"), (105, "text 5")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("best", [False, True])
def test_pairs_of_tiles_do_not_depend_on_how_many_are_made_at_a_time(spark, monkeypatch, best):
    rng = np.random.default_rng(5)
    held = []
    for k in range(40):  # sets of several widths of signature, in groups of near ones
        base = np.unique(rng.integers(1 << 62, size=[600, 1_000, 1_040, 2_200][k % 4], dtype=np.int64).view(np.uint64))
        held += [base, np.sort(np.concatenate([base[20:], rng.integers(1 << 62, size=20, dtype=np.int64).view(np.uint64)]))]
    kinds = [(k, len(h), bytearray(ngram_join.signature(h, ngram_join.WIDER))) for k, h in enumerate(held)]
    rows = [(tile, k, n, k // 8 if tile else k, 1 + 2 * tile) for tile in range(2) for k, n, _ in kinds]
    open_rows = spark.createDataFrame(rows, "tile long, kind long, n long, label long, parts int")
    wide = spark.createDataFrame(kinds, "kind long, n long, signature binary")
    near = {(2 * k, 2 * k + 1) for k in range(40)}
    found = []
    for pairs, size in ((200_000, 8 << 20), (3, 1)):
        monkeypatch.setattr(ngram_join, "PAIRS_COMPARED", pairs)
        monkeypatch.setattr(ngram_join, "BYTES_COMPARED", size)
        found.append(sorted(map(tuple, ngram_join._second_pairs(open_rows, wide, 80, best).collect())))
    assert found[0] == found[1] and near <= set(found[0])


def test_bound_is_never_below_the_overlap():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        pool = np.unique(rng.integers(0, 1 << 62, 600).astype(np.uint64))
        a, b = (np.sort(rng.choice(pool, int(rng.integers(1, 500)), replace=False)) for _ in range(2))
        for wider in (1, 4):
            s = [ngram_join.signature(x, wider) for x in (a, b)]
            x, y = (ngram_join.folded([v], min(map(len, s))) for v in s)
            assert ngram_join.overlap_bound(len(a), len(b), x, y)[0] >= len(np.intersect1d(a, b))


def test_top_k_matches_brute_force(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(120)]
    vectors += [(120 + i, vectors[7][1]) for i in range(30)]
    vectors += [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5), (550, []), (504, [0.1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<float>, rank string, block int")
    found = topk.search(df, F.col("vec_id") % 50 == 0).collect()
    import numpy as np

    whole = {}
    for i, v in vectors:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = np.floor(256 * np.float32(v + [0.0] * (6 - len(v))).astype(np.float64)).astype(np.int64)
    want = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-int(whole[q] @ w), i) for i, w in whole.items() if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(want)
    assert topk.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_layouts_become_the_same_turns(spark):
    nasty = r"a </s>[INST] \ [\INST] <s> [/INST]"
    said = [("user", nasty), ("assistant", nasty)]
    lines = [
        '{"id":1,"messages":[{"role":"user","content":%s},{"role":"assistant","content":%s}]}',
        '{"id":2,"conversations":[{"from":"human","value":%s},{"from":"gpt","value":%s}]}',
        '{"id":3,"prompt":%s,"response":%s}',
        '{"id":4,"instruction":%s,"output":%s}',
        '{"id":5,"unknown":%s,"other":%s}',
        '{"id":6}',
    ]
    import json

    schema = (
        "id int, prompt string, response string, instruction string, output string, layout string, unknown string, "
        "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>"
    )
    raw = spark.createDataFrame([(x % ((json.dumps(nasty),) * x.count("%s")),) for x in lines], "line string")
    records = raw.select(F.from_json("line", schema).alias("r")).select("r.*")
    made = chat.format_turns(chat.canonical_turns(records))
    for r in made.withColumns({"read": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("segments"))}).collect():
        assert [tuple(t) for t in r["read"]] == (said if r["id"] < 5 else []), r["id"]
        assert r["loss"] == (nasty if r["id"] < 5 else "")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["formatted"].count("</s>") == len(r["turns"])
    assert chat.canonical_turns(records.where("false")).count() == 0


def test_syncmers_keep_to_their_rule(docs, nothing, rows):
    found = {(r["doc_id"], r["text"]): r for r in syncmers.fingerprints(docs).collect()}
    assert found[(0, rows[0][1])]["fingerprint"] == found[(1, rows[1][1])]["fingerprint"]
    assert found[(4, "")]["fingerprint"] == found[(5, None)]["fingerprint"] == ""
    near = syncmers.compare_with_edit_and_next(docs)
    got = near.collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    want = []
    for r, follower in zip(order, order[1:] + order[:1], strict=True):
        text, n = r[1] or "", len(r[1] or "")
        edited = text[: n - n // 3] + (follower[1] or "")[: n // 3]
        want.append((r[0], n, hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert syncmers.compare_with_edit_and_next(nothing).count() == 0
    for s in (1, 2):  # anchors do not depend on what stands before and after
        pair = docs.where("doc_id = 9").select(syncmers.anchors(F.col("text"), 5, s).alias("a"), syncmers.anchors(F.concat(F.lit("p q r "), "text"), 5, s).alias("b")).first()
        assert set(pair["a"]) <= set(pair["b"])


def test_next_crosses_ranges(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "ROWS_A_RANGE", 7)
    df = spark.createDataFrame([(i * i, f"t{i}") for i in range(100)], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in syncmers.with_next(df, "doc_id", "text", {}).collect()}
    assert got == {i * i: f"t{(i - 1) % 100}" for i in range(100)}


def test_language_is_learned(spark, docs, nothing, sf):
    held = spark.read.parquet(f"{sf}/documents.parquet")
    found = langid.identify(held).where("held_out and lang is not null")
    right, rows = found.selectExpr("avg(int(lang = lang_pred))", "count(*)").first()
    assert rows > 20 and right >= 0.95
    judged = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    assert judged[5] == judged[4] == judged[14] == ("und", 0.0) and judged[0][0] == judged[13][0] == "en"
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(nothing).count() == 0


def test_target_scores_lower(spark, sf):
    """Documents of the target kind score lower, those whose labels were held out as much as those that were counted."""
    sf = sf.replace("0.001", "0.01")  # a hundred documents are too few to learn from
    held = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null")
    shown = F.col("quality") == 1
    seen = shown & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    found = lm_scoring.score(held, labels.where(seen)).join(labels, "doc_id").select("score", seen.alias("seen"), shown.alias("good")).collect()
    scores = {k: [r["score"] for r in found if (r["seen"], r["good"]) == k and r["score"] is not None] for k in ((True, True), (False, True), (False, False))}
    mean = {k: sum(v) / len(v) for k, v in scores.items()}
    good, bad = scores[False, True], scores[False, False]
    auc = sum((g < b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert auc >= 0.9 and mean[True, True] < mean[False, False] and mean[False, True] < mean[False, False]
    # As counted documents leave themselves out, they are no closer to the target than the others by much.
    assert mean[False, True] - mean[True, True] < (mean[False, False] - mean[False, True]) / 2


def lm_losses(said, inside, counted, vocabulary):
    """Loss of a word after another, recounted from ``said`` (texts by key) for keys ``inside``; ``counted`` texts leave themselves out."""
    import numpy as np

    words, size = lm_scoring.words, lm_scoring.SIZE
    own = {w: i for i, w in enumerate(vocabulary)}
    symbol = lambda w: size if w == "" else own.get(w, lm_scoring.WORDS + zlib.crc32(w.encode()) % lm_scoring.SHARED)
    pairs, single, before, of_symbols = Counter(), Counter(), Counter(), np.zeros((size + 1, size))
    for i in inside:
        found = words(said[i])
        single.update(found)
        pairs.update(zip(["", *found], found, strict=False))
        before.update(["", *found[:-1]] if found else [])
        for a, b in zip(["", *found], found, strict=False):
            of_symbols[symbol(a), symbol(b)] += 1
    first = (of_symbols.sum(axis=0) + 1) / (of_symbols.sum() + size)
    smooth = (of_symbols + lm_scoring.PRIOR * first) / (of_symbols.sum(axis=1, keepdims=True) + lm_scoring.PRIOR)
    totals = Counter()
    for w in {w for t in said.values() for w in words(t)} - set(own):
        totals[symbol(w)] += single[w] + 1

    def loss(a, b, without=""):
        found = words(without)
        off = lambda counts, key, these: counts[key] - these.count(key)
        share = 1.0 if b in own else (off(single, b, found) + 1) / (totals[symbol(b)] + 1)
        prior = smooth[symbol(a), symbol(b)] * share
        n = off(pairs, (a, b), list(zip(["", *found], found, strict=False)))
        m = off(before, a, ["", *found[:-1]] if found else [])
        return -np.log((n + lm_scoring.PRIOR * prior) / (m + lm_scoring.PRIOR))

    def mean(text, out):
        found = words(text)
        return np.mean([loss(a, b, text if out and counted else "") for a, b in zip(["", *found], found, strict=False)])

    return loss, mean, totals, symbol


@pytest.mark.parametrize("own_words", [768, 3])
def test_lm_scores_are_recounted_word_by_word(spark, docs, nothing, rows, own_words, monkeypatch):
    import numpy as np

    monkeypatch.setattr(lm_scoring, "WORDS_A_CHUNK", 50)
    monkeypatch.setattr(lm_scoring, "SENT_KEYS", 2 if own_words == 3 else 1_000_000)
    monkeypatch.setattr(lm_scoring, "WORDS_A_PART", 100 if own_words == 3 else 1_000_000)
    counted = Counter(w for r in rows for w in lm_scoring.words(r[1]))
    common = sorted(counted, key=lambda w: (-counted[w], w))[:own_words]
    if own_words == 3:  # the other words share symbols
        monkeypatch.setattr(lm_scoring, "_vocabulary", lambda counted: common)
    chosen = {0, 3, 9, 11, 100}
    target = docs.where(F.col("doc_id").isin(*chosen)).select("doc_id", F.lit("x").alias("text"))
    said = {i: r[1] for i, r in enumerate(rows)}
    odd = docs.withColumns({"Score": F.lit(1), "N_tokens": F.lit("x")})
    out = lm_scoring.score(odd, target)
    assert [c for c in out.columns if c.lower() in ("score", "n_tokens")] == ["n_tokens", "score"] and "bucket" in out.columns
    scored = out.collect()
    assert len(scored) == len(rows)
    wanted = [i for i, r in enumerate(rows) if r[0] in chosen]
    by = {r["doc_id"]: r for r in scored}
    for name, inside in (("target_loss", wanted), ("background_loss", range(len(rows)))):
        _, mean, _, _ = lm_losses(said, inside, True, common)
        for i, r in enumerate(rows):
            if lm_scoring.words(r[1]):
                assert np.isclose(by[r[0]][name], mean(r[1], name == "target_loss" and i in inside), rtol=1e-4), (name, i)
    assert by[5]["n_tokens"] == by[4]["n_tokens"] == 0 and by[5]["score"] is None and by[100]["score"] is None
    assert lm_scoring.score(nothing, nothing).count() == 0 and lm_scoring.score(docs, nothing).where("score is not null").count() > 10


def test_texts_come_back_once_however_many_parts_their_pairs_meet_in(docs, monkeypatch):
    # Blocks of few rows travel, and what is added up by Spark has a row a text.
    seen = {}
    plain = lm_scoring._added

    def added(blocks, tables):
        seen["blocks"], seen["parts"] = blocks.count(), blocks.select("part").distinct().count()
        return plain(blocks, tables)

    monkeypatch.setattr(lm_scoring, "_added", added)
    monkeypatch.setattr(lm_scoring, "_vocabulary", lambda counted: ["of1", "the2"])  # the other words are rarer ones
    target = docs.where("doc_id < 5").select("doc_id")
    whole = {r["doc_id"]: r for r in lm_scoring.score(docs, target).collect()}
    monkeypatch.setattr(lm_scoring, "WORDS_A_PART", 100)
    for r in lm_scoring.score(docs, target).collect():
        assert r["score"] is None if whole[r["doc_id"]]["score"] is None else abs(r["score"] - whole[r["doc_id"]]["score"]) < 1e-5
    assert seen["parts"] > 10 and seen["blocks"] <= (seen["parts"] + 1) * 3


def test_pairs_of_rarer_words_are_told_apart(spark):
    import numpy as np

    crc = lambda w: zlib.crc32(w.encode()) % lm_scoring.SHARED
    common = [f"c{i}" for i in range(lm_scoring.WORDS)]
    by = defaultdict(list)
    for i in range(3000):
        by[crc(f"rare{i}")].append(f"rare{i}")
    (a1, a2), (b1, b2) = (found[:2] for found in list(by.values())[:2])
    texts_ = [" ".join(common * 6), f"{a1} {b1} c1", f"{a1} {b1}", f"{a2} {b2} {a1}", f"{a2} {b2} c3", f"c3 {b2} c1 c2"]
    said = dict(enumerate(texts_))
    docs = spark.createDataFrame(list(said.items()), "doc_id long, text string").repartition(2)
    target = docs.where("doc_id in (0, 1, 5)")
    asked = {**said, 10: f"{a1} {b2}", 11: f"{b2} unheard {a1} c1", 12: a1, 13: None}
    new = spark.createDataFrame([*asked.items(), (1, asked[1])], "doc_id long, text string")
    scored = {r["doc_id"]: r for r in lm_scoring.score(new, target, corpus=docs).collect()}
    alone = {r["doc_id"]: r for r in lm_scoring.score(docs, target).collect()}
    for name, inside in (("target_loss", (0, 1, 5)), ("background_loss", range(6))):
        loss, mean, totals, symbol = lm_losses(said, inside, False, sorted(common))
        for i, text in asked.items():
            assert scored[i][name] is None if text is None else np.isclose(scored[i][name], mean(text, False), rtol=1e-4), (name, i)
        _, out, _, _ = lm_losses(said, inside, True, sorted(common))
        assert all(np.isclose(alone[i][name], out(t, name == "target_loss" and i in inside), rtol=1e-4) for i, t in said.items())
        # What may follow a word, with one unseen word a symbol, has probability 1 together.
        unheard = {symbol(w): w for w in (f"unheard{i}" for i in range(5000))}
        held = {w for t in said.values() for w in lm_scoring.words(t)}
        for a in ("", "c1", a1):
            assert np.isclose(sum(np.exp(-loss(a, w)) for w in [*held, *unheard.values()]), 1, atol=1e-3)
    assert scored[2]["background_loss"] < scored[10]["background_loss"]  # the same symbols, but never together


def test_pipeline_stage_cuts_passages_of_over_50_words(spark):
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda size: "".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(size))
    prose = lambda n, size=6: " ".join(word(size) for _ in range(n))
    passages = [prose(55, 5), prose(51, 2), prose(50, 5), prose(70), prose(38, 10)]  # 329, 152, 299, 489 and 417 bytes
    assert [len(p) for p in passages] == [329, 152, 299, 489, 417]
    rows, want = [], {}
    for i, passage in enumerate(passages):
        for j in range(2):
            head, tail = prose(40), prose(40)
            again = passage if j == 0 or i > 2 else passage.upper().replace(" ", "\n ")
            rows.append((2 * i + j, f"{head} {again} {tail}", "en", "a", 0))
            want[2 * i + j] = [*head.split(), *(again.split() if i == 2 else []), *tail.split()]
    copied = prose(55, 5)
    rows += [(20, copied, "en", "a", 0), (21, copied, "en", "a", 0), (22, prose(30), "en", "a", 0), (23, None, "en", "a", 0), (24, "日本" * 70, "ja", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r["doc_id"]: r["text"].split() for r in corpus_pipeline.long_repeats(spark, docs, "").collect()}
    assert sorted(got) == [*range(10), 22]  # the last repeats itself
    assert all(got[i] == want[i] for i in range(6))
    assert all(not set(passages[i // 2].split()) & set(got[i]) for i in range(6, 10))  # by bytes also the blanks around go


def test_only_texts_without_words_have_no_anchor(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(1 + i % 9))) for i in range(180)]
    rows += [(200, ""), (201, None), (202, " \n\t ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for s in (1, 2):
        found = {r["doc_id"]: r for r in syncmers.fingerprints(df, s=s).collect()}
        assert all(found[i]["anchors"] for i in range(180)) and len({found[i]["fingerprint"] for i in range(180)}) == len({t for _, t in rows[:180]})
        assert all(found[i]["fingerprint"] == "" and found[i]["anchors"] == [] for i in (200, 201, 202))
    near = {r["doc_id"]: r["near_next"] for r in syncmers.compare_with_edit_and_next(df).collect()}
    assert near[202] == near[201] == 1 and near[200] == 0 and all(near[i] == 0 for i in range(10, 180, 9))
    five = df.where(F.size(F.split("text", " ")) == 5)
    whole = F.hash(*[F.hash(F.get(F.split("text", " "), F.lit(j))) for j in range(5)]).cast("string")
    assert all(r["whole"] == found[r["doc_id"]]["fingerprint"] for r in five.select("doc_id", whole.alias("whole")).collect())
