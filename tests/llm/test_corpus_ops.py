"""The corpus operators against brute force, and on nulls, empty and long texts, ties, repeats, clashing columns and empty tables."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from spanlake.llm import decontaminate, html_text, language, licenses, packing, quality, simhash, substring, toxicity, url_filter  # noqa: E402
from spanlake.llm.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, rest string, block long, fp long, n_words string, kept boolean, t string"
VOCABULARY = [a + b for a in ("ba", "ko", "mi", "ru", "té") for b in ("n", "lo", "xi", "s,", "Q")]


def corpus():
    """Hand-made hard cases and random texts with shared passages and near copies."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    passage, first = prose(40), prose(120)
    texts = [None, "", " \t\n\x0b ", "one", "two words", "a b c", first, first, first + " end", first.replace("ban", "ban", 1) + "\nx", "A" * 50_000,
             "the same " * 3_000, prose(20_000), "line\n" * 60, "\u2003odd\u00a0space\x1cx\x85y", "#$% &|<> " * 40]
    texts += [prose(rng.randint(5, 90)) + " " + passage + " " + prose(rng.randint(0, 30)) for _ in range(12)]
    texts += [prose(rng.randint(1, 150)) for _ in range(40)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[6], rows[20], rows[20], (None, passage), (None, None), (-5, passage + " tail")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    langs = ["en", "fr", None]
    full = [(i, t, langs[k % 3], "s" if k % 4 else None, 1, "r", "q", 7, 8, "w", None, "t") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_features(text):
    w = split(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, rows, nothing):
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *plain_features(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.judge(nothing).count() == 0


def test_quality_thresholds_follow_the_group(spark):
    """A share of symbols that is usual in one source is out of line in another; small groups take their language's fence."""
    def text(k, marks):
        return " ".join(f"word{k}x{i}" for i in range(100)) + " " + "#" * marks
    data = [(k, text(k, k % 5), "en", "plain") for k in range(300)] + [(1_000 + k, text(k, 80 + k % 30), "en", "code") for k in range(300)]
    data += [(5_000, text(1, 95), "en", "plain"), (5_001, text(2, 95), "en", "code"), (5_002, text(3, 3_000), "en", "tiny")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[5_000] and got[5_001] and not got[5_002]
    assert all(v for k, v in got.items() if k < 5_000)


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(ids, prints, radius=2):
    label = list(range(len(ids)))
    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def test_simhash(docs, rows, nothing):
    got = simhash.near_classes(docs).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    expected = plain_components([i for i, _ in rows], prints)
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == Counter((i, f, c) for (i, _), f, c in zip(rows, prints, expected))
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns
    assert Counter(r.doc_id for r in one.collect()) == Counter({c for c in expected if c is not None} | set()) + Counter({None: sum(i is None for i, _ in rows)})
    assert simhash.near_classes(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def test_simhash_divides_large_nodes(spark):
    """Chains and clusters around one fingerprint, with nodes far above the limit, against all pairs."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    near = {base}
    for _ in range(250):
        x = base
        for k in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(k)
        near.add(x)
    chain, x = [], int(rng.integers(0, 2**63))
    for k in range(20):
        chain.append(x)
        x ^= 3 << (3 * k)
    fps = sorted(near | set(chain) | set(int(v) for v in rng.integers(0, 2**63, 300)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for limit in (8, 500):
        found = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), node_entries=limit))
        got = {r.node: r.component for r in found.collect()}
        expected = plain_components(signed, fps)
        assert [got.get(s, s) for s in signed] == expected


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200), (300, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_cut(rows):
    least = {}
    order = [(i if i is not None else 1 << 62, split(t)) for i, t in rows]
    for i, w in order:
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            least[g] = min(i, least.get(g, i))
    for (d, _), (i, w) in zip(rows, order):
        gone = {k + j for k in range(len(w) - 12) if least[tuple(w[k:k + 13])] < i for j in range(13)}
        yield d, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()


@pytest.mark.parametrize("size", [300, 4_000_000])
def test_substring(docs, rows, nothing, monkeypatch, size):
    monkeypatch.setattr(substring, "BLOCK_BYTES", size)
    monkeypatch.setattr(substring, "BLOCKS", 1_000_000)
    assert Counter(map(tuple, substring.digests(docs).collect())) == Counter(plain_cut(rows))
    left = substring.deduplicated(docs)
    assert left.columns == docs.columns
    lost = {(d, n) for d, n, gone, _ in plain_cut(rows) if gone == n and n}
    assert left.count() == len(rows) - sum((d, n) in lost for d, n, gone, _ in plain_cut(rows) if gone == n)
    assert substring.digests(nothing).count() == 0 and substring.deduplicated(nothing).columns == nothing.columns


def fold(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_leaks(rows, items):
    wins = {}
    for k, t in items:
        w = fold(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i:i + 10]), set()).add(str(k))
    for d, t in rows:
        w = fold(t)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i:i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[g]
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, rows, nothing, monkeypatch):
    shared = next(t for i, t in rows if i == -5)
    items = [(1, shared), (2, shared[40:160].upper()), (10, "one"), (11, None), (12, " .,"), (13, "two words"), (14, "never here at all"), (2, shared)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = Counter(plain_leaks(rows, items))
    assert Counter(map(tuple, decontaminate.digests(docs, bench).collect())) == expected
    # Items in several blocks, texts in many shards.
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 500)
    many = decontaminate.occurrences(docs, bench, block_bytes=150).collect()
    assert Counter((r.doc_id, sum(s.end - s.start for s in r.found.spans)) for r in many) == Counter({(d, h): 0 for d, _, h, *_ in expected} | Counter((d, h) for (d, _, h, *_), n in expected.items() for _ in range(n)))
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    whole = [x for x in expected.elements() if not x[2] or x[2] < x[1]]
    assert clean.count() == len(whole)
    assert not [r for r in decontaminate.digests(clean, bench.where("item_id = 1")).collect() if r.n_hit > 12]
    assert decontaminate.digests(nothing, bench).count() == 0
    assert not decontaminate.digests(docs, bench.where("false")).where("contaminated").count()


def test_fm_index():
    rng = np.random.default_rng(0)
    for n, sigma in ((1, 2), (50, 3), (400, 5), (300, 200)):
        text = rng.integers(1, sigma, n)
        index = decontaminate.FMIndex(text, sample=4)
        pats = [text[i:i + k] for i in range(0, n, 7) for k in (1, 2, 5) if i + k <= n] + [np.array([sigma + 3])]
        width = max(map(len, pats))
        codes = np.zeros((len(pats), width), np.int64)
        for i, p in enumerate(pats):
            codes[i, width - len(p):] = p
        lo, hi = index.count(codes, np.array([len(p) for p in pats]))
        for p, a, b in zip(pats, lo, hi):
            assert sorted(index.locate(np.arange(a, b))) == [i for i in range(n - len(p) + 1) if (text[i:i + len(p)] == p).all()]


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_paths()[0])
    whole.encode_special_tokens = True
    got = packing.packed(docs, with_ids=True).collect()
    ids = Counter((i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    by_sequence = {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length and 0 < r.length <= 2048
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048
    total = sum(r.length for r in got)
    assert total == sum(len(t) * n for (_, t), n in ids.items())
    singles = Counter((i, t) for (i, t), n in ids.items() for _ in range(n) if len(t) <= 2048)
    assert singles == Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got if r.length < 2048 and r.piece == 0 and r.start == 0 and (r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) in singles)
    assert all(r.length == 2048 for r in got if r.piece > 0)
    assert len(by_sequence) <= -(-total // 2048) + 2
    assert packing.packed(nothing).count() == 0


def test_packing_added_tokens():
    """Ids are those of the tokenizer's defaults, also where a text holds the literal of an added token."""
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(packing.default_paths()[0]), packing.encoder(*packing.default_paths())
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\u4e2d", "<|endoftext| >", "plain text, é", ""):
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids
    assert 50256 in encode("a <|endoftext|> b")


def test_packing_plan_is_gapless():
    rng = np.random.default_rng(1)
    counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 2049, 5_000), return_counts=True))}
    runs = packing.plan(counts)
    fill, placed = Counter(), Counter()
    for length, _, n, first, offset in sorted(runs, key=lambda r: r[4]):
        placed[length] += n
        for s in range(first, first + n):
            assert fill[s] == offset
            fill[s] += length
    assert placed == counts and max(fill.values()) <= 2048
    assert len(fill) <= 1.02 * sum(k * n for k, n in counts.items()) / 2048 + 1
    assert packing.plan({}) == [] and [packing.pieces_of(n) for n in (1, 2048, 2049, 5000)] == [
        [(0, 1)], [(0, 2048)], [(0, 1), (1, 2048)], [(0, 904), (904, 2048), (2952, 2048)]]


@pytest.mark.parametrize("counts, most", [({100: 1_000}, 50), ({1: 5_000}, 3), ({300: 1_000, 50: 300, 20: 200}, 167), ({1_000: 100, 524: 200}, 100)])
def test_packing_hot_length(counts, most):
    """Pieces of one hot length share the sequences they open, where that takes fewer sequences."""
    fill, placed, ranks = Counter(), Counter(), set()
    for length, rank, n, first, offset in sorted(packing.plan(counts), key=lambda r: r[4]):
        placed[length] += n
        ranks |= {(length, r) for r in range(rank, rank + n)}
        for s in range(first, first + n):
            assert fill[s] == offset
            fill[s] += length
    assert placed == counts and len(ranks) == sum(counts.values()) and max(fill.values()) <= 2048
    assert sorted(fill) == list(range(len(fill))) and len(fill) <= most


def plain_segments(scores):
    """Recursive definition: the best segment (first, shortest), then the same to its left and right."""
    best = max(((sum(scores[i:j]), -i, i - j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[1], -best[1] - best[2]
    return plain_segments(scores[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in plain_segments(scores[j:])]


def test_segments():
    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.choice((-3, -2, -1, 2, 4)) + rng.random() / 100 for _ in range(rng.randint(0, 24))]
        got, expected = toxicity.segments(np.array(scores)), plain_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected]
        assert np.allclose([s for *_, s in got], [s for *_, s in expected])


def test_toxicity(spark, docs, rows, nothing):
    rng = random.Random(1)
    texts = {k: " ".join(rng.choice(VOCABULARY) for _ in range(60)).split() for k in range(600)}
    toxic = {k for k in texts if k % 6 == 0}
    for k in toxic:
        texts[k][20:20] = ["Vile!", "wretch,", "vile"]
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k in toxic)) for k in texts] + [(3, 1, None), (99_999, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table, labels).collect()
    assert len(got) == 600 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == (r.doc_id in toxic) == (r.score >= 0.5) for r in got)
    assert all(r.passages and r.passages[0].start >= 18 and r.passages[0].end <= 26 for r in got if r.doc_id in toxic)
    out = toxicity.toxicity(docs, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0}


def test_language(spark, docs, rows, nothing):
    rng = random.Random(4)
    words = {"aa": ["bado", "gado", "deba"], "bb": ["xuzi", "zixu", "xizu"], "cc": ["ñandé", "ñéda"]}
    data = [(k, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for k in range(300) for lang in [sorted(words)[k % 3]]]
    data += [(1_001, None, "aa"), (1_002, "1234 !", None), (1_003, "", "bb")]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.languages(table).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in data[:300])
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1_001, 1_002, 1_003))
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    out = language.languages(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for t in {t for i, t in rows if i == r.doc_id} for c in t or "")) for r in out if r.doc_id is not None)
    assert language.languages(nothing).count() == 0
    assert {r.lang_pred for r in language.languages(table.withColumn("lang", language.F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_counts():
    """N-gram counts of a text against a plain count."""
    letters = language.Letters()
    for text in ("ab", "Ab ab\nc", "é1é  x", ""):
        rows_, values, has = language.grams([None, text, "zz"], letters)
        padded = " " + re.sub(r"[^a-zé]+", " ", text.lower()).strip() + " "
        grams = Counter(padded[i:i + k] for k in (1, 2, 3) for i in range(len(padded) - k + 1))
        expected = Counter({g: n for g, n in grams.items() if g.strip() and (len(g) < 3 or g[1] != " ")}) if padded.strip() else Counter()
        assert Counter(letters.unpack(int(v)) for v in values[rows_ == 1]) == expected and has.tolist() == [False, bool(padded.strip()), True]


def test_licenses(spark, docs, rows, nothing):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    data, expected = [], {}
    for k, (name, text) in enumerate(licenses.TEMPLATES.items()):
        for j in range(12):
            data.append((k * 100 + j, prose(rng.randint(0, 90)) + "\n" + (text.upper() if j % 2 else text) + " " + prose(rng.randint(0, 90))))
            expected[k * 100 + j] = name
    data.append((9_999, "This program is free software you can modify it under other terms"))
    got = {r.doc_id: r.licenses.split(",") for r in licenses.licenses(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(name in got[k] for k, name in expected.items()) and got[9_999] == [""]
    spans = licenses.scan(spark.createDataFrame([(1, "x y Released under the MIT License. z")], "doc_id long, text string")).first().notices
    assert [(s.name, s.start, s.end, s.containment) for s in spans] == [("mit", 2, 7, 1.0)]
    assert licenses.licenses(docs).where("n_notices > 0").count() == 0 and licenses.licenses(docs).count() == len(rows)
    assert licenses.licenses(nothing).count() == 0


def test_licenses_bands_suit_every_template():
    """At most 1 in a million is missed for every template; templates of one shingle, whatever their hash, are found."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    assert sorted(t.name for ts in scanner.classes.values() for t in ts) == sorted(licenses.TEMPLATES)
    assert all(t.missed(len(scanner.keys[t.name])) <= 1e-6 for ts in scanner.classes.values() for t in ts)
    rng = random.Random(9)
    prose = lambda n: " ".join(f"{rng.choice(VOCABULARY)[:2]}{rng.randint(0, 10**6)}" for _ in range(n))
    for _ in range(200):
        notice = prose(5)
        texts = [f"{prose(rng.randint(24, 31))} {notice} {prose(20)}" for _ in range(10)]
        found = licenses.Scanner({"one": notice}).matches(licenses.Words(licenses.folded_words(licenses.pa.array(texts))))
        assert [[f["name"] for f in x] for x in found] == [["one"]] * len(texts)


def test_url_filter(spark):
    urls = {1: ("http://a.com/x", "com/", "allow"), 2: ("https://EXAMPLE.com/en/1?q", "example.com/en/", "block"), 3: ("http://www.example.com/en/1", "www.example.com/en/", "allow"),
            4: ("http://example.com", None, "allow"), 5: ("http://m.b.net/es/", "net/es/", "block"), 6: ("http://m.b.net/ES/", None, "allow"), 7: ("net/es/", None, "allow"),
            8: (None, None, "allow"), 9: ("", None, "allow"), 10: ("http://x-casino.org/", None, "block"), 11: ("http://myexample.com/en/", "com/", "allow"),
            12: ("http://a.org/?u=http://b.net/fr/", None, "allow"), 13: ("http://net/fr/" + "y" * 20_000, "net/fr/", "block"), 14: ("http://a.org/xxx", None, "block"), 15: ("x\n://h.com/a\nb", "com/", "allow")}
    data = [(k, u, "clash") for k, (u, *_) in urls.items()] * 2 + [(None, None, "clash")]
    got = url_filter.url_filter(spark.createDataFrame(data, "page_id long, url string, verdict string")).collect()
    assert len(got) == len(data)
    assert {r.page_id: (r.rule, r.verdict) for r in got if r.page_id} == {k: v[1:] for k, v in urls.items()}
    assert {r.page_id: (r.host, r.path) for r in got}[15] == ("h.com", "/a\nb") and {r.page_id: (r.host, r.path) for r in got}[7] == ("", "")
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def page(body, k=0):
    return f'<!DOCTYPE html><html><head><title>T{k}</title><script>if (a < b) "</p>";</script></head><body><nav><a href="/">Home</a></nav>{body}<footer>&copy; {k}'


def test_html_blocks():
    article = '<article><header><h1>Ti &amp; tle</h1></header><p><b>one  two\n<br><p title="a>b">three &lt;four</p><ul><li>x<li>y</ul><div class="share-box">Share</div><div id="comments"><p>no</p></div></article>'
    assert html_text.extract(page(article), {}) == "Ti & tle\none two\nthree <four\nx\ny"
    assert html_text.extract(None, {}) == html_text.extract("", {}) == html_text.extract("<p", {}).replace("<p", "") == ""
    assert html_text.extract("plain &eacute; text", {}) == "plain é text"
    assert html_text.extract("<div>" * 5_000 + "deep" + "</div>" * 5_000, {}) == "deep"


def test_html_wrappers(spark):
    """A site without article elements: the varying part is found, the constant parts go."""
    body = lambda k: (f'<div class="top"><span>Site name</span></div><div class="box"><div class="stars"><span>Rate this page</span></div>'
                      + "".join(f"<p>Story {k} says sentence {j} of many words.</p>" for j in range(3 + k % 4)) + '</div><div class="end"><span>Call us</span></div>')
    pages = [(k, f"http://h.org/{k}", page(body(k), k), "clash") for k in range(20)]
    pages += [(100, "http://lone.org/", page("<div><p>Only page here.</p></div>"), "c"), (101, None, None, "c"), (102, "x", "", "c"), (None, "http://h.org/1", page(body(1), 1), "c")] * 2
    got = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(pages)
    text = {r.page_id: r.text for r in got}
    assert all(text[k] == "\n".join(f"Story {k} says sentence {j} of many words." for j in range(3 + k % 4)) for k in range(20))
    assert text[100] == "Only page here." and text[101] == text[102] == "" and text[None] == text[1]
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_matching():
    a, b = html_text.parse("<div><p>x</p><ul><li>1<li>2</ul><p>y</p></div>"), html_text.parse("<div><p>z</p><p>y</p><i>w</i></div>")
    assert html_text.match(a, b, {}) == 4                   # root, div and both p
    assert [(x.tag, y.tag) for x, y in html_text.aligned(a, b)].count(("p", "p")) == 2


def test_html_keeps_all_sections(spark):
    """Headline, lead and every section stay, whatever share one of them has, with and without a wrapper."""
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    post = lambda k: (f'<div class="post"><h1>{words(k, 5)}</h1><div class="lead">{words(k + 1, 30)}</div><div class="body">{words(k + 2, 70)}</div>'  # noqa: E731
                      f'<section><p>{words(k + 3, 300)}</p></section><section><p>{words(k + 4, 20)}</p></section></div>')
    text = lambda k: "\n".join((words(k, 5), words(k + 1, 30), words(k + 2, 70), words(k + 3, 300), words(k + 4, 20)))
    assert html_text.extract(page(post(0)), {}) == text(0)
    assert html_text.extract(page("<article><p>one</p></article><article><p>two</p></article>"), {}) == "one\ntwo"
    odd = 990       # has varying text beside its host's slot
    pages = [(k, f"http://h.org/{k}", page(post(k) + '<div class="end"><span>Call us</span></div>' + ("<div><p>More here.</p></div>" if k == odd else ""))) for k in range(0, 1_000, 10)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: text(k) + ("\nCall us\nMore here." if k == odd else "") for k, *_ in pages}


def test_html_wrappers_see_all_pages(spark):
    """Copies, two layouts on a host and a byline that all pages but one share."""
    who = lambda k: "Bob" if k == 77 else "Ann"
    def body(k):
        inner = f'<div class="by"><span>{who(k)}</span></div><div>Story {k} of many words.</div>'
        if k % 2:
            return f'<div class="a"><div class="top"><span>Site A</span></div><div class="box">{inner}</div><div class="end"><span>Call A</span></div></div>'
        return f'<section class="b"><div class="up"><span>Site B</span></div><div class="text">{inner}<div>Tail {k}.</div></div><div class="low"><span>Call B</span></div></section>'
    pages = [(k, f"http://h.org/{k}", page(body(k), k)) for k in range(100)] + [(1_000 + k, f"http://h.org/{k}", page(body(1), 1)) for k in range(200)]
    pages = [(i, u, h.replace("Ann", "Eve") if i == 50 else h) for i, u, h in pages]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)).collect()}
    assert got == {i: f"{'Eve' if i == 50 else who(k)}\nStory {k} of many words." + ("" if k % 2 else f"\nTail {k}.") for i, k in [(i, 1 if i >= 1_000 else i) for i, *_ in pages]}


def test_html_aligns_whole_pages(spark):
    """A long menu before the text, text below 120 levels, and a box at the end of the page."""
    menu = "<div>" + "".join(f"<div><a href='{i}'>item {i}</a></div>" for i in range(3_000)) + "</div>"
    body = lambda k: menu + "<div>" * 120 + f"<div>Story {k}.</div><div>End {k}.</div><div class='x'>Call us</div>" + "</div>" * 120
    pages = [(k, f"http://h.org/{k}", page(body(k), k)) for k in range(8)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k}.\nEnd {k}." for k in range(8)}


def plain_match(a, b):
    """Simple tree matching by its recursion."""
    if a.name != b.name:
        return 0
    left, right = ([k for k in x.kids if not isinstance(k, str)] for x in (a, b))
    table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + plain_match(x, y))
    return table[-1][-1] + 1


@pytest.mark.parametrize("cells", [4, 20_000_000])
def test_tree_matching_is_largest(monkeypatch, cells):
    monkeypatch.setattr(html_text, "TABLE_CELLS", cells)
    rng = random.Random(8)
    def tree(depth):
        node = html_text.Node(rng.choice("ab") if depth < 4 else "a")
        node.kids = [rng.choice("xy")] * rng.randint(0, 1) + [tree(depth - 1) for _ in range(rng.randint(0, 5) if depth else 0)]
        return node
    for _ in range(60):
        a, b = tree(4), tree(4)
        pairs = html_text.aligned(a, b)
        assert html_text.match(a, b, {}) == plain_match(a, b) == len(pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs) and all(x.name == y.name for x, y in pairs)
