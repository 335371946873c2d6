"""Operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuewright.llm import bpe, fingerprint, html_extract, jaccard, lattice, license_scan, packing, toxicity, words
from cuewright.llm.components import connected_components
from cuewright.llm.exact_dedup import DigestIndex, exact_dedup
from cuewright.llm.line_dedup import line_dedup
from cuewright.llm.queries import oracle_sql, queries
from oracle import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, uid string, sig long, word string, n long, key string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    "A Plain text, with the MIT\nLicense and mit-license here.",
    None,
    "",
    " \t\n",
    "one two",
    "One  TWO",
    "x\x1cy ½ Ⅷ 𝟘𝟙 it's <|endoftext|> 日本語テキスト",
    LONG,
    LONG + " tail",
    "a" * 3000,
    "Released under the Apache License, Version 2.0.",
    "the gnu general public license version 3 general public license",
    *[" ".join(f"t{j if j != i else 'new' + str(i)}" for j in range(60)) for i in range(8)],
]


def table(spark, texts=TEXTS, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", 0, 7, "u", 1, "w", 2, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def with_repeats(spark):
    return table(spark).unionByName(table(spark, ["again", "again", None], [5, 5, None])).unionByName(table(spark, ["again"], [5]))


def rows(df):
    return [r.asDict() for r in df.collect()]


EVERY = {
    "fingerprints": lambda d: fingerprint.fingerprints(d),
    "bpe": lambda d: bpe.encode_digests(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    "jaccard": lambda d: jaccard.jaccard_components(d),
    "license": lambda d: license_scan.license_scan(d),
    "lines": lambda d: line_dedup(d, min_sites=2),
    "lattice": lambda d: lattice.lattice_scores(d, P.path("piece_bpe_32k.model")),
    "pack": lambda d: packing.pack(d, P.path("byte_bpe_50k.json")),
    "exact": lambda d: exact_dedup(d),
    "toxicity": lambda d: toxicity.toxicity(d, d.select("doc_id", F.lit(0).alias("toxic"))),
}


@pytest.mark.parametrize("name", EVERY)
def test_odd_rows(spark, name):
    assert EVERY[name](table(spark, [])).count() == 0
    out = rows(EVERY[name](with_repeats(spark)))
    n = len(TEXTS) + 4
    assert (len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)) if name == "pack" else (len(out) == n)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    same(spark, queries()[name], oracle_sql()[name])


def test_fingerprints(spark):
    out = {r["doc_id"]: r for r in rows(fingerprint.fingerprints(table(spark)))}
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        m, after = len(t) // 4, texts[(i + 1) % len(texts)]
        edited = t[: len(t) - m] + after[:m]
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out[i]["n_chars"] == len(t)
        assert out[i]["fingerprint"] == fingerprint.fingerprint(t) and out[i]["edited_fingerprint"] == fingerprint.fingerprint(edited)
        common = next((k for k, (a, b) in enumerate(zip(t, edited)) if a != b), min(len(t), len(edited)))
        assert out[i]["shared_edited"] == common
    assert fingerprint.likeness(out[7]["fingerprint"], out[8]["fingerprint"]) > 0.95
    a = fingerprint.PrefixHash(fingerprint.code_points("xxabcabc"))
    assert fingerprint.spans_equal(a, 2, a, 5, 3) and not fingerprint.spans_equal(a, 1, a, 5, 3)


def test_bpe_matches_tiktoken(spark):
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for ahead in (0, 400_000):
        for r in rows(bpe.encode_digests(table(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ahead=ahead)):
            text = TEXTS[r["doc_id"]] or ""
            ids = np.array(enc.encode_ordinary(text), "<u4")
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def test_texts_are_cut_between_words():
    split, rng = words.splitter(P.PATTERN), random.Random(3)
    letters = " \n\t\x0b\x1c\x85\xa0\u3000\0ab'st'reÀé1²½٣_-.,!\U0001d7d8\U00010400日   "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    parts, ends = words.cut_all(pa.array([*texts, None]))
    parts, at = parts.to_pylist(), 0
    for text, end in zip([*texts, ""], ends.tolist(), strict=True):
        assert parts[at:end] == words.cut(text), text
        assert [w for part in parts[at:end] for w in split(part)] == split(text), text
        at = end


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_jaccard_is_exact(spark, k, num, den):
    import random

    random.seed(k)
    base = [[f"b{g}w{j}" for j in range(random.choice((3, 9, 20, 60, 150)))] for g in range(25)]
    texts = []
    for i in range(300):
        w = list(random.choice(base))
        for _ in range(random.choice((0, 0, 1, 1, 2, 3))):
            w[random.randrange(len(w))] = f"e{random.randrange(40)}"
        texts.append(" ".join(w))
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    for r in rows(jaccard.jaccard_components(table(spark, texts), k=k, num=num, den=den)):
        assert r["component_id"] == find(r["doc_id"]) and r["n_shingles"] == len(sets[r["doc_id"]])


def test_jaccard_in_many_blocks(spark, monkeypatch):
    """Buckets dealt over blocks, large groups, and long sets whose count vectors have different lengths."""
    monkeypatch.setattr(jaccard, "TREE", 4)
    rng, texts = random.Random(5), []
    for g, (n, members) in enumerate(((1030, 8), (1000, 6), (515, 7), (505, 5), (40, 45), (12, 30))):
        base = [f"g{g}w{j}" for j in range(n)]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, n // 40, n // 12))):
                w[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w[: n - rng.choice((0, 0, n // 30))]))
    sets = [shingles(t, 3) for t in texts]
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if x == b else x for x in comp]
    assert len(set(comp)) < len(comp) - 40
    for r in rows(jaccard.jaccard_components(table(spark, texts), k=3, num=9, den=10)):
        assert r["component_id"] == comp[r["doc_id"]]


def test_near_copies_go_by_row(spark):
    copy, own, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    ids = [1, 2, 2, 1, None, None, None, 3, 4, 4]
    texts = [copy, copy + " x", own, copy, copy, third, third + " x", "", None, None]
    out = [(r["doc_id"], r["text"]) for r in rows(jaccard.drop_near_copies(table(spark, texts, ids)))]
    assert len(out) == 6 and sorted(i for i, _ in out if i) == [1, 2, 3, 4, 4]
    assert (1, copy) in out and (2, own) in out and [t for i, t in out if i is None][0].startswith(third)


def test_rtree_loses_nothing():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (500, jaccard.GROUPS)).astype(np.int32)
    points[1::2] = points[::2] + (rng.random((250, jaccard.GROUPS)) < 0.05)
    sizes = points.sum(1)
    tree = jaccard.RTree(sizes, points)
    for i in range(0, 500, 25):
        want = np.flatnonzero(19 * np.minimum(points, points[i]).sum(1) >= 9 * (sizes + sizes[i]))
        assert sorted(tree.search(int(sizes[i]), points[i], 9, 10).tolist()) == want.tolist()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_license(spark):
    import re

    out = {r["doc_id"]: r for r in rows(license_scan.license_scan(table(spark)))}
    for i, t in enumerate(TEXTS):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        hits = [(s, label) for p, label in license_scan.BASE for s in range(len(words)) if words[s : s + len(p.split())] == p.split()]
        starts = [s for s, _ in hits]
        assert (out[i]["n_words"], out[i]["n_base"]) == (len(words), len(hits))
        assert (out[i]["first_word"], out[i]["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert out[i]["base_labels"] == ",".join(sorted({x for _, x in hits})) and set(out[i]["base_labels"].split(",")) <= {*out[i]["labels"].split(","), ""}
    assert out[10]["labels"] == "apache,apache-2.0" and out[11]["labels"] == "gpl,gpl-3.0"
    for rule in license_scan.rules():
        assert re.compile(rule["regex"])


def test_license_against_every_rule(spark):
    """Neither the gate nor the keywords change what all rules over all texts find."""
    rng, found = random.Random(8), license_scan.rules()
    assert len(found) > 400

    def sample(pattern):
        """A text that the pattern matches."""
        out = pattern.replace("(?<!\\S)", "").replace("(?!\\S)", "")
        out = re.sub(r"\(\?![^()]*(?:\([^()]*\))?[^()]*\)", "", out)
        while m := re.search(r"\(\?:([^()]*)\)(\?|\{\d,?(\d?)\})?", out):
            choice = rng.choice(m[1].split("|"))
            times = 1 if not m[2] else rng.choice([0, 1]) if m[2] == "?" else 1
            out = out[: m.start()] + choice * times + out[m.end() :]
        out = re.sub(r"\[([^\]])[^\]]*\]", r"\1", out).replace("\\d{4}", "2019").replace("\\d", "3").replace("\\w+", "word").replace("\\S{1,2}", "e")
        return re.sub(r" ?\?", "", out)

    texts = [x for rule in found for x in [sample(rule["regex"])] if re.search(rule["regex"], x)]
    assert len(texts) > 0.9 * len(found)
    words = "the gnu general public license version 3 mit apache bsd cc by sa under terms of licensed copyright 2019 limit commit 2 0".split()
    texts += [" ".join(rng.choice([rng.choice(words), rng.choice(texts[: len(found) // 2])]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    breaks = [" ", "\n", "-", ", ", " / "]
    texts = ["".join(w if w != " " else rng.choice(breaks) for w in re.split("( )", t)) for t in texts]
    texts = [t.title() if rng.random() < 0.3 else t for t in texts]
    got = {r["doc_id"]: r for r in rows(license_scan.license_scan(table(spark, texts)))}
    for i, text in enumerate(texts):
        joined = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))))
        hits = sorted((m.start(), -m.end(), -r["rank"], r["label"], r["conf"]) for r in found for m in re.finditer(r["regex"], joined, re.ASCII) if m.end() > m.start())
        kept = []
        for start, over, rank, label, conf in hits:
            if not any(s <= start and over >= o and rank >= k for s, o, k, _, _ in kept):
                kept.append((start, over, rank, label, conf))
        base = {x for p, x in license_scan.BASE if f" {p} " in f" {joined} "}
        assert got[i]["labels"] == ",".join(sorted(base | {k[3] for k in kept})), text
        assert got[i]["n_detections"] == len(kept) and got[i]["score"] == pytest.approx(1.0 if base else max((k[4] for k in kept), default=0.0)), text


def test_exact_dedup_over_batches(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    first = rows(exact_dedup(table(spark, ["a  b", "a b", "a\tb ", None, ""], [3, 2, 4, 9, 8]), index))
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in first} == {3: (2, 2, False), 2: (2, 2, True), 4: (4, 1, True), 9: (8, 2, False), 8: (8, 2, True)}
    for _ in range(2):  # the second time as after a crash
        again = rows(exact_dedup(table(spark, ["a b", "new", "new"], [1, 5, 5]), DigestIndex(spark, str(tmp_path / "index"), 4), batch="second"))
        assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in again) == [(1, 2, False), (5, 5, False), (5, 5, True)]
        assert index.rows().count() == 4
    later = rows(exact_dedup(table(spark, ["new"], [4]), index))
    assert [(r["keep_id"], r["kept"]) for r in later] == [(5, False)]
    index.drop()
    assert not (tmp_path / "index").exists()


def test_lines(spark):
    docs = table(spark, ["keep\nshared line", "shared line \nown", "other\r\nshared line", None, ""])
    out = {r["doc_id"]: r for r in rows(line_dedup(docs, min_sites=3))}
    assert [out[i]["text"] for i in range(5)] == ["keep\nshared line", "own", "other\r", None, ""]
    assert [out[i]["n_removed"] for i in range(5)] == [0, 1, 1, 0, 0] and out[0]["key"] == "k"


def test_lines_of_a_hot_source(spark):
    import corpus_pipeline

    passage, twice = " ".join(f"word{i}" for i in range(55)), " ".join(f"other{i}" for i in range(55))
    texts = [f"own {i}\n{passage}\nshort one" + (f"\n{twice}" if i in (3, 17) else "") for i in range(30)]
    docs = table(spark, texts).withColumn("source", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("s"), "doc_id")).otherwise("hot"))
    out = {r["doc_id"]: r for r in rows(corpus_pipeline.drop_shared_lines(spark, docs, ""))}
    assert docs.select("source").distinct().count() == 4 and len(out) == 30
    for i, t in enumerate(texts):
        left = t if i == 0 else t.replace(f"{passage}\n", "")
        assert out[i]["text"] == left and out[i]["n_chars"] == (0 if i == 0 else len(left))


def test_lattice(spark):
    model = open(P.path("piece_bpe_32k.model"), "rb").read()
    lat, _ = lattice.weighted(model, {}, 3)

    def brute(s):
        if not s:
            return 1.0
        total = math.exp(sum(lat.bytes[b] for b in s[0].encode())) * brute(s[1:])
        return total + sum(math.exp(lat.pieces[s[:k]]) * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in lat.pieces)

    for w in ("the", "ñandú", "qzxj", "日本"):
        assert lat.word(w) == pytest.approx(math.log(brute(lattice.MARK + w)), rel=1e-9)
    texts = [t or "" for t in TEXTS]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c, ends = collections.Counter(), held.count(False)
    for t, h in zip(texts, held):
        c.update([] if h else t.encode().lower().split())
    n, v = sum(c.values()) + ends, len(c) + 1
    import sentencepiece

    sp, pieces = sentencepiece.SentencePieceProcessor(model_proto=model), collections.Counter()
    for word, k in c.items():
        for piece in sp.encode(word.decode("utf-8", "replace")):
            pieces[piece] += k
    learned, end = lattice.weighted(model, pieces, ends)
    for ahead in (0, 300_000):
        for r in rows(lattice.lattice_scores(table(spark), P.path("piece_bpe_32k.model"), ahead=ahead)):
            words_of = [w.decode("utf-8", "replace") for w in texts[r["doc_id"]].encode().lower().split()]
            assert r["score"] == pytest.approx((sum(map(learned.word, words_of)) + end) / math.log(10), rel=1e-9)
            w = texts[r["doc_id"]].encode().lower().split()
            base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in [*(c[a] for a in w), ends])
            assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == n and r["n_tokens"] == len(w) + 1
            assert r["n_known"] == sum(c[a] > 0 for a in w) + 1 and r["held_out"] == held[r["doc_id"]] and r["score"] < 0


def test_columns_that_clash(spark):
    docs = table(spark, ["keep\nshared line", "shared line \nown", "other\nshared line"])
    for name in ("_uid", "_id", "_row", "_text", "_gone"):
        named = docs.withColumn(name, F.lit("mine"))
        assert {r[name] for r in rows(line_dedup(named, min_sites=3))} == {"mine"}
        assert {r[name] for r in rows(jaccard.drop_near_copies(named))} == {"mine"}


def test_one_class_of_labels_keeps_all(spark):
    docs = table(spark, ["some text", "other text", None])
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.keep_clean(docs, labels).count() == 3 and toxicity.keep_clean(docs, labels.limit(0)).count() == 3


def test_merge_ranks_need_a_plain_file(tmp_path):
    import json

    plain = json.load(open(P.path("byte_bpe_50k.json")))
    assert packing.merge_ranks(P.path("byte_bpe_50k.json"))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": plain["pre_tokenizer"] | {"add_prefix_space": True}}):
        (tmp_path / "t.json").write_text(json.dumps(plain | change))
        assert packing.merge_ranks(str(tmp_path / "t.json")) is None


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(TEXTS)}
    out = rows(packing.pack(table(spark).coalesce(2), P.path("byte_bpe_50k.json")))
    cover, fill = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        cover[r["doc_id"]].append((r["start"], r["length"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, total in [*((cover[i], len(ids[i])) for i in ids), *((f, sum(n for _, n in f)) for f in fill.values())]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == total
    assert all(sum(n for _, n in f) <= 1024 for f in fill.values())


def test_kneser_ney_from_its_definition():
    words_of = (["abab", "abc", "cab", "ab", "c"] * 3 + ["dab"], ["bad", "bad", "dabb", "ab", "vile"])
    order, d, begin, stop = toxicity.ORDER, toxicity.DISCOUNT, toxicity.START, toxicity.STOP
    counts = (collections.Counter(), collections.Counter())
    for y, group in enumerate(words_of):
        for w in group:
            w = begin + w + stop
            for i in range(1, len(w)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        counts[y][w[i - n + 1 : i + 1]] += 1
    before = collections.defaultdict(set)  # what stands before an n-gram, in either class
    for gram in counts[0] | counts[1]:
        if len(gram) > 1:
            before[gram[1:]].add(gram[0])
    letters = {g for g in before if len(g) == 1}

    def lower(context, letter):
        """The backoff distribution that both classes share, from continuation counts."""
        rest = lower(context[1:], letter) if context else 1 / (1 + len(letters))
        after = {x: len(before[context + x]) for x in letters if context + x in before}
        if not sum(after.values()):
            return rest
        return (max(after.get(letter, 0) - d, 0) + d * len(after) * rest) / sum(after.values())

    def chance(y, context, letter):
        after = {x: counts[y][context + x] for x in letters if counts[y][context + x]}
        rest = lower(context[1:], letter)
        if not after:
            return rest
        return (max(after.get(letter, 0) - d, 0) + d * len(after) * rest) / sum(after.values())

    ratios = toxicity.Ratios((dict(counts[0]), dict(counts[1])))
    for w in ("ab", "bad", "vile", "abab", "dabbad", "zq", "v"):
        full, wanted = begin + w + stop, 0.0
        for i in range(1, len(full)):
            context = full[max(0, i - order + 1) : i]
            if not (len(context) == order - 1 or context[0] == begin):
                continue
            wanted += math.log10(chance(1, context, full[i]) / chance(0, context, full[i]))
        assert ratios.word(w.encode()) == pytest.approx(wanted, abs=1e-9)
    known = sum(chance(1, begin, x) for x in letters)
    assert known < 1 and known == pytest.approx(1, abs=0.2)  # the rest is for letters that no class has


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    bad = ["vile" + "".join(rng.choice(list("abcdefgh"), 3)) for _ in range(60)]
    texts, labels = [], []
    for i in range(600):
        w = list(rng.choice(plain, 40))
        labels.append((i, int(i % 4 == 0)))
        texts.append(" ".join(w if i % 4 else w + list(rng.choice(bad, 3))))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in rows(toxicity.toxicity(table(spark, texts), marks))}
    held = [i for i in out if out[i]["held_out"]]
    assert {i for i in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(out[i]["predicted"] == labels[i][1] for i in held) >= 0.97 * len(held)
    assert toxicity.keep_clean(table(spark, texts), marks).count() == sum(not r["predicted"] for r in out.values())
    assert all(r["score"] == 0 for r in rows(toxicity.toxicity(table(spark, texts[:3]), marks.limit(0))))


def test_pages(spark):
    page = (
        '<html><head><title>t</title></head><body><header>H</header><nav><a href="x">menu</a></nav><div class="cookie-notice">c</div>'
        '<div class="post-{n} content"><p>First &amp; <b>wo</b>rd {n}, some more text.<p>Second\n para<br>line &#8212; ok.<div class="ad">BUY</div><form>f</form></div>'
        '<aside>s</aside><div class="comments"><p>nice!</p></div><footer>F</footer><script>if (a<b) d("<p>x</p>")</script></body></html>'
    )
    data = [(i, f"http://h{i % 2}.org/{i}", page.replace("{n}", str(i))) for i in range(6)] + [(6, None, None), (7, "nonsense", ""), (8, "http://h0.org/x", "<p>cut off <b"), (8, "http://h0.org/x", "<p>cut off <b")]
    for limit in (10, 0):
        out = rows(html_extract.extract_pages(spark.createDataFrame(data, "page_id long, url string, html string"), broadcast_hosts=limit))
        got = {r["page_id"]: r["text"] for r in out}
        assert len(out) == len(data) and all(got[i] == f"First & word {i}, some more text. Second para line — ok." for i in range(6))
        assert (got[6], got[7], got[8]) == ("", "", "cut off")
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


BODY = "Some text of the article, more than enough of it. " * 5


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<div class="layout has-sidebar"><article><p>x y</p></article><div class="sidebar">s</div></div>', "x y"),
        ('<article class="post no-comments"><p>x y</p></article><div class="related"><article><p>r</p></article></div>', "x y"),
        ('<div id="page" class="header-fixed"><article><p>x y</p></article><div class="comments"><p>c</p></div></div>', "x y"),
        (f'<div id="page" class="header-fixed"><h1>x</h1><p>{BODY}</p><div class="comments"><p>c</p></div></div>', f"x {BODY.strip()}"),
        (f'<div class="content"><p>{BODY}</p></div><div class="comments"><article class="comment"><p>c</p></article></div>', BODY.strip()),
        ("<article><p>x <math><mi>a</mi></math> <video>film</video></p><object>y</object></article>", "x a film y"),
        ('<div class="ad">x</div>', ""),
    ],
)
def test_pages_with_marked_containers(source, text):
    assert html_extract.extract(source, None) == text


def test_pages_keep_whole_articles(spark):
    text, other = BODY.strip(), BODY.replace("Some", "Other").strip()
    lead = f'<article><h1>T</h1><p>lead</p><div class="content"><p>{text}</p></div></article><div class="ad">a</div>'
    parts = f'<body><div class="w"><div class="a"><section class="x"><p>{text}</p></section></div><div class="b"><section class="y"><p>{other}</p></section></div></div><nav>n</nav></body>'
    short = f'<body><main><p>{text}</p></main></body>'
    mixed = f'<body><main><p>Teaser.</p></main><div class="old"><p>{text}</p><p>{other}</p></div></body>'
    want = {lead: f"T lead {text}", parts: f"{text} {other}", short: text, mixed: f"{text} {other}"}
    pages = [("lead.org", lead)] * 3 + [("parts.org", parts)] * 3 + [("two.org", short)] * 3 + [("two.org", mixed)]
    data = [(i, f"http://{host}/{i}", source) for i, (host, source) in enumerate(pages)]
    for r in rows(html_extract.extract_pages(spark.createDataFrame(data, "page_id long, url string, html string"))):
        got, whole = r["text"], want[pages[r["page_id"]][1]]
        assert whole in got and got.removeprefix("Teaser. ") == whole


PROSE = "Words that speak of it at some length, and then of the rest. " * 4


@pytest.mark.parametrize(
    ("inside", "kept"),
    [
        ('<h2 id="cookies">Cookies</h2>', "Cookies"),
        ('<h2 id="search">Search</h2><p>How it works.</p>', "Search How it works."),
        (f'<section id="related-work"><h2>Related work</h2><p>{PROSE}</p></section>', f"Related work {PROSE.strip()}"),
        (f'<div id="social-media"><h3>Social media</h3><p>{PROSE}</p></div>', f"Social media {PROSE.strip()}"),
        ('<p>An <em class="notice">important</em> word.</p>', "An important word."),
        ('<p>Of <span class="search">engines</span> and <a class="related" href="x">others</a> too.</p>', "Of engines and others too."),
        ('<p class="copyright">Rights of the author are named here.</p>', "Rights of the author are named here."),
        ("<fieldset><legend>Group</legend><p>of fields</p></fieldset>", "Group of fields"),
        ('<map name="m"><area href="x"></map>', ""),
        # and what is none of the article
        (f'<section id="related-posts"><h2>Related posts</h2>{"<a href=x>One of the other posts of this site</a> " * 9}</section>', ""),
        (f'<section id="comments"><h2>Comments</h2><p>{PROSE}</p></section>', ""),
        (f'<section id="cookies" class="cookie-notice"><h2>Cookies</h2><p>{PROSE}</p></section>', ""),
        (f'<section id="related-work"><h2>More</h2><p>{PROSE}</p></section>', ""),
        ('<p><span class="ad">Buy this now</span></p>', ""),
        ('<p><span class="share">Share this on the net</span> now</p>', "now"),
        ('<p class="ad">Buy.</p>', ""),
        ('<p>Seen. <span hidden>Not seen.</span></p>', "Seen."),
    ],
)
def test_pages_keep_words_marked_by_chance(inside, kept):
    page = f"<body><nav>n</nav><article><h1>T</h1><p>{BODY}</p>{inside}<p>{BODY}</p></article><footer>f</footer></body>"
    assert html_extract.extract(page, None) == " ".join(["T", BODY.strip(), *([kept] if kept else []), BODY.strip()])


def test_pages_keep_headings_with_any_id():
    rng = random.Random(2)
    for _ in range(200):
        words = rng.sample(["Cookies", "search", "related", "Menu", "of", "the", "sidebar", "ad", "header", "shares", "comments"], rng.randint(1, 4))
        title, level = " ".join(words), rng.randint(1, 6)
        page = f'<main><p>{BODY}</p><h{level} id="{"-".join(words).lower()}">{title}</h{level}><p>{BODY}</p></main>'
        assert html_extract.extract(page, None) == f"{BODY.strip()} {title} {BODY.strip()}"


def test_index_keeps_its_bucket_count(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    first = DigestIndex(spark, path, 4)
    assert sum(r.kept for r in first.ingest(docs).collect()) == 50
    spark.sql(f"DROP TABLE {first.table}")  # as in a later session, whose catalogue does not know it
    for wrong in (64, 3):
        with pytest.raises(ValueError, match="4 buckets"):
            DigestIndex(spark, path, wrong)
    for buckets in (None, 4):
        again = DigestIndex(spark.newSession(), path, buckets)
        assert again.buckets == 4 and sum(r.kept for r in again.ingest(docs).collect()) == 0 and again.rows().count() == 50
        spark.sql(f"DROP TABLE IF EXISTS {again.table}")
    (tmp_path / "index" / DigestIndex.COUNT).unlink()
    with pytest.raises(ValueError, match="no bucket count"):
        DigestIndex(spark, path)
    with pytest.raises(ValueError, match="at least one"):
        DigestIndex(spark, path, 0)


def test_pages_of_any_depth_and_columns_of_any_name(spark):
    deep = "<div>" * 30_000 + "deep text, here" + "</div>" * 30_000
    docs = spark.createDataFrame(
        [(1, "http://a.x/1", deep), (1, "http://a.x/1", deep), (2, None, None), (3, "no url", ""), (None, "http://a.x/2", "<p>only this"), (4, "http://b.x", "<li><b><i>" * 20_000 + "x")], "page_id long, url string, html string"
    )
    docs = docs.withColumns({c: F.lit("mine") for c in ("host", "path", "salt", "text", "n_chars", "share")})
    for hosts in (0, 10):
        out = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in rows(html_extract.extract_pages(docs, broadcast_hosts=hosts)))
        assert out == [(0, "only this", 9), (1, "deep text, here", 15), (1, "deep text, here", 15), (2, "", 0), (3, "", 0), (4, "x", 1)]
    assert html_extract.extract_pages(docs.limit(0)).count() == 0


def test_pages_against_their_makers(spark):
    """Articles of known blocks in random templates, with boilerplate around and inside."""
    rng, pages, wanted = random.Random(12), [], {}
    word = lambda: "".join(rng.choice("abcdeéß&") for _ in range(rng.randint(2, 9))).replace("&", "&amp;")
    said = lambda n: " ".join(word() for _ in range(n))
    plain = lambda t: " ".join(t.replace("&amp;", "&").replace("<b>", "").replace("</b>", "").split())
    for host in range(6):
        wrap = rng.choice(["<article class='post'>%s</article>", "<main>%s</main>", "<article><div class='entry-content no-ads'>%s</div></article>", "<div id='page' class='has-sidebar'><article>%s</article></div>"])
        for page in range(12):
            blocks, inner = [], ""
            for _ in range(rng.randint(3, 9)):
                text = said(rng.randint(12, 40)) + ",\n  " + f"<b>{word()}</b> end"
                tag = rng.choice(["p", "p", "div", "h2", "blockquote"])
                blocks.append(plain(text))
                inner += f"<{tag}>{text}</{tag}>" if rng.random() < 0.7 else f"<section><{tag}>{text}</{tag}></section>"
                inner += rng.choice(["", "", f"<div class='ad'>{said(4)}</div>", f"<script>var x = '{said(3)}'</script>", f"<aside>{said(5)}</aside>", "<!-- <p>gone</p> -->"])
            inner += rng.choice(["", f"<div class='comments'><p>{said(25)}</p><p>{said(25)}</p></div>"])
            body = f"<nav><a href='/'>{said(2)}</a></nav><header>{said(3)}</header>{wrap % inner}<div class='sidebar'>{said(8)}</div><footer>{said(4)}</footer>"
            key = host * 100 + page
            wanted[key] = " ".join(blocks)
            pages.append((key, f"https://h{host}.example/{page}", f"<html><head><title>{said(2)}</title></head><body>{body}</body></html>"))
    out = {r["page_id"]: r["text"] for r in rows(html_extract.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")))}
    assert out == wanted


def test_pipeline(spark):
    import corpus_pipeline

    out = rows(corpus_pipeline.run(spark, "/root/testdata/sf0.001"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, "/root/testdata/sf0.001")
        assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert {r["doc_id"] for r in out} == set(ids) and 0 < len(ids) <= docs.count()


def save(spark, docs, labels, path):
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_on_no_rows(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, save(spark, docs, labels, tmp_path)).count() == 0


def test_pipeline_by_brute_force(spark, tmp_path):
    """Stage after stage on planted rows: shared passages, near and exact copies, nulls, empty texts, repeated ids."""
    import corpus_pipeline

    rng = random.Random(21)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage, short = say(55), "home about contact"
    texts = [f"{say(60)}\n{say(50)}" for _ in range(40)]
    for i in range(0, 12):
        texts[i] += f"\n{passage}" if i % 2 else f"\n  {passage}\t\n{say(9)}"
    for i in range(10, 34):
        texts[i] = f"{short}\n{texts[i]}"
    texts += [passage, short, None, "", " \n\t", texts[30], texts[31], None]
    words_of = texts[32].split(" ")
    texts.append(" ".join(["other", *words_of[1:]]))
    ids = [*range(len(texts) - 1), 3]
    sources = [f"s{i % 4}" if i < 12 else f"s{i % 12}" if i % 9 else None for i in range(len(texts))]
    made = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources, strict=True)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    path = save(spark, docs, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"), tmp_path)

    stages = dict(corpus_pipeline.STAGES)
    first = rows(stages["toxicity"](spark, docs, path))
    assert len(first) == len(made)  # labels of one class reject nothing

    strip = lambda line: line.strip(" \t\n\x0b\x0c\r")
    sites, first_id = collections.defaultdict(set), {}
    for i, t, _, s, _ in made:
        for line in (t or "").split("\n") if t is not None else ():
            sites[strip(line)] |= {s} - {None}
            first_id[strip(line)] = min(i, first_id.get(strip(line), i))
    gone = {k for k, found in sites.items() if k and len(found) >= (3 if len(k) >= 60 else 10)}
    assert passage in gone and short in gone
    left = []
    for i, t, lang, s, n in made:
        lines = [] if t is None else t.split("\n")
        stay = [x for x in lines if strip(x) not in gone or first_id[strip(x)] == i]
        text = None if t is None else "\n".join(stay)
        if len(stay) == len(lines) or strip(text):
            left.append((i, text, lang, s, n if len(stay) == len(lines) else len(text)))
    second = stages["line_dedup"](spark, docs, path)
    key = lambda r: (r[0], r[1] or "", r[3] or "")
    assert sorted((tuple(r) for r in second.collect()), key=key) == sorted(left, key=key)

    sets, comp = [shingles(r[1], 5) for r in left], list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if x == b else x for x in comp]
    groups = collections.defaultdict(list)
    for i, c in enumerate(comp):
        groups[c].append(i)
    third = [r[0] for r in stages["ngram_jaccard_join"](spark, second, path).collect()]
    assert sorted(third) == sorted(min(left[i][0] for i in g) for g in groups.values()) and len(third) < len(left)

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = rows(corpus_pipeline.run(spark, path))
    by_doc = collections.Counter()
    for r in pieces:
        by_doc[r["doc_id"]] += r["length"]
    tokens = collections.Counter()
    for r in stages["ngram_jaccard_join"](spark, second, path).collect():
        tokens[r["doc_id"]] += len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert by_doc == tokens
