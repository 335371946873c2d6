"""Phrases, token counts and divergences against brute force on small tables with nulls, odd texts, ties and repeated rows."""

import collections
import random
import re
import string

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuewright.llm import collocations, slices
from cuewright.llm.collocations import phrase_counts
from cuewright.llm.divergence import source_divergence
from cuewright.llm.token_counts import added_tokens, token_counts

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n long, key string, term string, word string, rank int, tail string"
PATH = P.path("byte_bpe_50k.json")


def table(spark, found):
    """Rows of (doc_id, text, lang, source), with columns whose names the operators use within."""
    return spark.createDataFrame([(*r, 3, "k", "t", "w", 1, "x") for r in found], SCHEMA)


def prose(seed, n=60):
    rng = random.Random(seed)
    words = ["The", "the", "Old", "house", "by", "river", "ÉTÉ", "été", "x\0y", "a\x01", "\x01", "\0", "don't", "naïve", "日本", "of", "end"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!? ", "\x0b", " - "]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words[: rng.randint(3, len(words))]) + rng.choice(marks) for _ in range(rng.randint(0, 40)))
        if i % 4 == 0:
            text += " the old house by the river, a\x01 \0 x\0y"
        rows.append((i, text, rng.choice(["en", "de", None, "und", "z\0", ""]), rng.choice(["a", "b", "c", None, ""])))
    rows += [(None, None, None, None), (7, "", "en", "a"), (7, "   \t\n", "en", "empty"), (8, "...", "de", "b"), (9, "solo", "lonely", "only"), (9, None, "void", "one"), (9, "", "void", "two")]
    return rows + [(5, "the old house by the river " * 400, "en", "a"), (5, "the old house by the river " * 400, "en", "a")]


def brute_phrases(rows, max_n, least, top, covered):
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, max_n + 1):
                    if i + k <= len(words):
                        counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        mine, found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}, []
        for g, a in mine.items():
            score, _, l, r = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            within = (b for h, b in mine.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)))
            if not any(100 * b >= covered * a for b in within):
                found.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (s, a, g, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("max_n", "least", "top"), [(4, 3, 2000), (4, 2, 7), (2, 2, 50), (5, 1, 100)])
def test_collocations(spark, max_n, least, top):
    rows = prose(max_n)
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, rows), max_n=max_n, least=least, top=top).collect())
    assert got == brute_phrases(rows, max_n, least, top, 80) and len(got) > 5
    assert collocations.collocations(table(spark, []), least=least).count() == 0


def test_phrases_over_task_edges(spark):
    """One phrase over many tasks."""
    rows = [(i, " ".join(["a", "b", f"c{i % 5}", f"d{i % 60}"] * 3), "en", "s") for i in range(300)]
    docs = table(spark, rows).select("lang", "text").repartition(7)
    words = spark.createDataFrame([(f"en\0{w}", 10**6) for w in ["a", "b", *[f"c{i}" for i in range(5)], *[f"d{i}" for i in range(60)]]], "key string, n long")
    want = collections.Counter()
    for _, text, _, _ in rows:
        w = text.split()
        want.update("\0".join(["en", *w[i : i + k]]) for i in range(len(w)) for k in (2, 3, 4) if i + k <= len(w))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.key: r.n for r in phrase_counts(docs, words, 4, 20).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: n for k, n in want.items() if n >= 20}


@pytest.mark.parametrize(("rows_a_batch", "rows_a_task"), [(1, 1), (1, 5), (2, 1000), (3, 7), (1000, 1000)])
def test_stack_over_batches_and_tasks(rows_a_batch, rows_a_task):
    rng = random.Random(rows_a_batch)
    keys = sorted(("\0".join([rng.choice(["de", "en"]), *(rng.choice("abc") for _ in range(rng.randint(2, 4)))]) for _ in range(200)), reverse=True)
    want = collections.Counter()
    for key in keys:
        w = key.split("\0")
        want.update("\0".join(w[: k + 1]) for k in range(2, len(w)))
    whole, cut = {}, collections.Counter()
    for at in range(0, len(keys), rows_a_task):
        mine = keys[at : at + rows_a_task]
        batches = [pa.RecordBatch.from_arrays([pa.array(mine[i : i + rows_a_batch]), pa.array([1] * len(mine[i : i + rows_a_batch]))], ["key", "n"]) for i in range(0, len(mine), rows_a_batch)]
        edges = 0
        for found in collections_of(collocations._counted(4, 5)(iter(batches))):
            assert found["words"] == found["key"].count("\0")
            if found["edge"]:
                edges += 1
                cut[found["key"]] += found["n"]
            else:
                assert found["key"] not in whole and found["n"] >= 5
                whole[found["key"]] = found["n"]
        assert edges <= 6
    assert not whole.keys() & cut.keys()
    assert whole | {k: n for k, n in cut.items() if n >= 5} == {k: n for k, n in want.items() if n >= 5}


def collections_of(batches):
    return [r for batch in batches for r in batch.to_pylist()]


def test_bits(spark):
    keys = [f"en\0w{i}" for i in range(5000)]
    table = collocations.frequent_bits(spark.createDataFrame([(k, 30 if i % 2 else 29) for i, k in enumerate(keys)], "key string, n long"), 30)
    import zlib

    import numpy as np

    has = collocations._has(np.frombuffer(table, np.uint8), np.array([zlib.crc32(k.encode()) % collocations.BITS for k in keys]))
    assert has[1::2].all() and has[::2].sum() < 20 and len(table) == collocations.BITS // 8 + 4096


@pytest.mark.parametrize("head", [0, 3, 300_000])
def test_token_counts(spark, head):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    letters = " \n\t\x0b\x1c\x85\xa0　\0ab'st'reÀé1²½٣_-.,!\U0001d7d8\U00010400日   "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", " <|endoftext|>  x ", "same text", "same text", "a" * 5000, "word " * 20_000, " ".join(f"w{i}x" for i in range(9000))]
    texts += ["x " * 256, "x " * 255 + "x y", "Ünïcode don't they're " * 30]
    library = Tokenizer.from_file(PATH)
    rows = [(None if i % 50 == 0 else i // 2, t, "en", "s") for i, t in enumerate(texts)]
    got = sorted(map(str, (tuple(r) for r in token_counts(table(spark, rows), PATH, head=head).collect())))
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert got == sorted(map(str, ((i, len((t or "").encode()), k, k > 512) for (i, t, *_), k in zip(rows, n, strict=True))))
    assert token_counts(table(spark, []), PATH).count() == 0


def test_token_counts_refuse_other_vocabularies():
    with pytest.raises(ValueError, match="byte-level"):
        added_tokens(P.path("word_bpe_49k.json"))
    assert added_tokens(PATH) == ["<|endoftext|>"]


def brute_divergence(rows, min_docs, top):
    n, df, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        n[lang, source].update(terms)
        df[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in df[lang].items() if k >= min_docs]

        def prices(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // q
        whole = prices(sum((n[lang, s] for s in sources), collections.Counter()))
        by = {s: prices(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(f(by[s][t], by[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(by[s][t], whole[t])) for t in kept if n[lang, s][t] and by[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, o, v, i) for i, (o, v) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize(("min_docs", "top"), [(3, 200), (1, 4), (99, 5)])
def test_source_divergence(spark, min_docs, top, monkeypatch):
    rows = prose(9, 120) + [(0, "word " * 50_000, "de", "a")]
    want = brute_divergence(rows, min_docs, top)
    assert sorted(tuple(r) for r in source_divergence(table(spark, rows), min_docs, top).collect()) == want and len(want) > 30
    monkeypatch.setattr("cuewright.llm.divergence.BROADCAST_GROUPS", 0)
    assert sorted(tuple(r) for r in source_divergence(table(spark, rows), min_docs, top).collect()) == want
    assert source_divergence(table(spark, [])).count() == 0


def test_prices_beyond_64_bits(spark):
    from cuewright.llm.divergence import price

    row = spark.sql("SELECT 50000000000000L AS c, 70000000000001L AS t, 13L AS v").select(price(F.col("c"), F.col("t"), F.col("v")).alias("p")).first()
    assert row.p == 1 + 10**9 * (50000000000000 + 1) // (70000000000001 + 13)


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["aaa", None, "bb", "", "ccccc", "d"])], ["t"])
    assert [b.num_rows for b in slices.slices(iter([batch]), "t", 5)] == [4, 1, 1]
