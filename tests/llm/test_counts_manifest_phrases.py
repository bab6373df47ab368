"""Token counts, the Merkle manifest and phrases against the library and brute force, with nulls, copies, ties and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrane.llm import merkle, phrases, token_counts

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, n string, path string, levels string, N_Tokens string"


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_match_the_library(spark, vocabulary):
    held = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: len(held.encode(t or "", add_special_tokens=False).ids)
    rng, parts = random.Random(1), ["a", "e", " ", "  ", "\n", "\t", "'s", "'S", "9", "é", "日", "😀", "՘", "\U00010940", "<|endoftext|>", "<|", "!"]
    parts += ["\x00", "\x1c", " ", "　", "​", "the", "ing", "᠎", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [None, "", "ab" * 3000, "日本語" * 900, " " * 2000, "word " * 1024, "word " * 1025, "x", "x"]
    df = spark.createDataFrame([(i, t, "q", "q") for i, t in enumerate(texts)], "doc_id long, text string, N_Tokens string, lang string").repartition(3)
    found = token_counts.count_tokens(df, vocabulary)
    assert found.columns == ["doc_id", "text", "lang", "n_bytes", "n_tokens", "over_limit"]
    for r in found.collect():
        n = count(r["text"])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 1024), r["text"]
    assert token_counts.count_tokens(df.where("false"), vocabulary).count() == 0


def test_cuts_agree_with_the_library_on_every_code_point(vocabulary):
    counter = token_counts.Counter(vocabulary)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}  {chr(c)}x" for c in points[start : start + 4096])
        if counter.unsure(text):
            # Only code points that are cut by the pattern count here.
            text = "".join(x for x in re.findall(r"(?s)a.1.!.  .x", text) if not counter.unsure(x))
        assert [text[a:b] for _, (a, b) in counter.library.pre_tokenize_str(text)] == counter.cut(text)


def test_whole_tokens_are_proved(vocabulary):
    held = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    some = random.Random(2).sample(sorted(vocabulary.whole), 3000)
    assert all(len(held.encode(t, add_special_tokens=False).ids) == 1 for t in some if list(held.pre_tokenizer.pre_tokenize_str(t))[1:] == [])
    assert vocabulary.merged(list(b"a" * 40)) == vocabulary._merged_long(list(b"a" * 40))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def manifest_of(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) for rows (doc_id, source, lang, n_chars, text)."""

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([digest("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
        return levels

    def path(levels, i):
        found = []
        for nodes in levels[:-1]:
            found.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else None, i & 1))
            i //= 2
        return found

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for held in by.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {x: tree([leaf_of(r) for r in by[x]]) for x in order}
    top, out = tree([trees[x][-1][0] for x in order]), []
    for place, x in enumerate(order):
        for i, r in enumerate(by[x]):
            steps, changed = path(trees[x], i) + path(top, place), list(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                changed[3] += 1
            node = leaf_of(changed)
            for other, right in steps:
                node = digest(node if other is None else other + node if right else node + other)
            out.append((r[0], leaf_of(r), trees[x][-1][0], top[-1][0], digest("".join(o for o, _ in steps if o)), node, node == top[-1][0]))
    return out


def entries(rng, n):
    rows = [(rng.choice([i, i, None, 5]), rng.choice(["a", None, "é"]), rng.choice(["en", "en", "de", None, "z"]), rng.choice([None, i]), rng.choice(["x", None, "", "日本"])) for i in range(n)]
    return rows + [rows[3]] * 40 + [(7, None, "solo", 1, "t" * 100_000)]


@pytest.mark.parametrize("digits", [2, 8])
def test_manifest_matches_brute_force(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rows = entries(random.Random(digits), 90 if digits == 2 else 600)
    df = spark.createDataFrame([(*r, "q", "q", "q", "q") for r in rows], SCHEMA).repartition(5)
    changed = {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    found = merkle.verify(df, "lang", "doc_id", fields, changed)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, manifest_of(rows)))
    assert merkle.verify(df.where("false"), "lang", "doc_id", fields, {}).count() == 0


def test_wanted_leaves_only(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 2)
    df = spark.createDataFrame([(i, "b" if i % 9 else "a", f"t{i}") for i in range(60)], "id long, g string, text string")
    held = merkle.build(df, "g", "id", ["id", "text"], ["id"])
    wanted = spark.createDataFrame([("sb", 0), ("sb", 52), ("sa", 3), ("sa", 99), ("none", 0)], "group string, rank long")
    found = merkle.proofs(held, wanted).select("*", "member.*", merkle.folded("member.leaf").alias("folded")).collect()
    assert sorted(r["id"] for r in found) == [1, 27, 59] and all(r["folded"] == r["root"] for r in found)
    everything = {r["id"]: r["path"] for r in merkle.proofs(held).select("member.id", "path").collect()}
    assert len(everything) == 60 and all(everything[r["id"]] == r["path"] for r in found)


def mined(rows, least, best):
    counts, totals, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, f in counts.items():
        held, kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, []
        for p, a in held.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            inside = (b for q, b in held.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if all(100 * b < 80 * a for b in inside):
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:best])]
    return sorted(out)


@pytest.mark.parametrize(("budget", "held", "best"), [(1_000_000, 300_000, 2000), (300, 500, 7), (10, 3, 2000)])
def test_phrases_match_brute_force(spark, monkeypatch, budget, held, best):
    for name, value in (("BUDGET", budget), ("HELD", held), ("SAMPLED", 3)):
        monkeypatch.setattr(phrases, name, value)
    rng, words = random.Random(3), ["a", "b", "C", "of", "The", "é", "ab\x01", "ab", " x", "z9"]
    rows = []
    for _ in range(400):
        said = (rng.choice([*words, f"rare{rng.randrange(3000)}"]) + rng.choice(["", "", "", "", ", ", "\t", "\n"]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), " ".join(said)))
    rows += [("en", "the quick brown fox jumps the quick")] * 50 + [("en", None), (None, ""), ("fr", " \t ,."), ("fr", "w" * 50_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(6)
    found = phrases.collocations(df, least=5, best=best)
    assert sorted(map(tuple, found.collect())) == mined(rows, 5, best)
    assert phrases.collocations(df.where("false")).count() == 0
