"""Language decisions, license containment and toxicity scores against plain restatements."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from spanlake.llm import language, licenses, toxicity  # noqa: E402
from spanlake.llm.common import Words, folded_words  # noqa: E402


# ---- languages ----------------------------------------------------------------------------------------

def plain_grams(text, code):
    """n-grams of a text within words and their blanks, as tuples of codes."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    out = Counter()
    for w in words:
        c = [code(x) for x in w]
        out.update((x,) for x in c)
        c = [1, *c, 1]
        out.update(zip(c, c[1:]))
        out.update(zip(c, c[1:], c[2:]))
    return out


def plain_match(text, learned, size):
    alphabet = sorted({c for x in learned.values() for g in x for c in g if c.isalpha()})
    code = lambda c: alphabet.index(c) + 2 if c in alphabet else len(alphabet) + 2
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    mine = sorted(plain_grams(text, code).items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:size]
    # A blank between two words is one symbol in both.
    distance = {}
    for lang in sorted(learned):
        rank = {tuple(1 if c == " " else code(c) for c in g): r for r, g in enumerate(learned[lang])}
        distance[lang] = sum(abs(rank[g] - place) if g in rank else size for place, (g, _) in enumerate(mine))
    best = min(distance, key=lambda k: (distance[k], k))
    nearest, second = sorted(distance.values())[:2]
    return best, min(1.0, max(0.0, 1 - nearest / max(second, 1e-9)))


@pytest.mark.parametrize("size", [12, 400])
def test_language_decisions(spark, size):
    rng = random.Random(4)
    stock = {"aa": "ka lo mi ruta sel", "bb": "öt enä kylä yö sel", "cc": "тут дом кот сел"}
    prose = lambda lang, n: " ".join(rng.choice(stock[lang].split()) + rng.choice(["", "s", ","]) for _ in range(n))
    train = spark.createDataFrame([(prose(lang, 60), lang) for lang in stock for _ in range(6)], "text string, lang string")
    learned = language.profiles(train, size)
    texts = [prose(rng.choice(list(stock)), rng.randint(1, 40)) for _ in range(60)] + [prose("aa", 3) + " " + prose("bb", 3) for _ in range(10)]
    texts += ["", None, "12 34 _", "ωμέγα 漢字 ωμέγα", "KA Lo\n\nmi-ruta", "x", "sel sel"]
    got = language.Matcher(learned, size).match(texts)
    for text, lang, score in zip(texts, *got):
        want, at = plain_match(text, learned, size)
        assert lang == want and score == pytest.approx(at, abs=1e-12), text


# ---- licenses -----------------------------------------------------------------------------------------

def plain_notices(text, templates):
    """Names of the templates of which some aligned window of the text holds enough shingles; word tuples, no hashes, no bands."""
    words = folded_words(pa.array([text]))[0].as_py() or []
    found = set()
    for name, body in templates.items():
        own = folded_words(pa.array([body]))[0].as_py()
        size, width = min(5, len(own)), max(4, 1 << (len(own) - 1).bit_length())
        shingles = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)}
        for lo in range(0, max(1, len(words)), width):
            window = words[lo:lo + 2 * width]
            here = {tuple(window[i:i + size]) for i in range(len(window) - size + 1)}
            if len(shingles & here) >= 0.8 * len(shingles):
                found.add(name)
    return found


def test_license_containment():
    rng = random.Random(9)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    noise = [w for t in licenses.TEMPLATES.values() for w in t.split()] + ["alpha", "beta", "gamma"]
    texts = [None, "", "license"]
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(list(licenses.TEMPLATES.values())).split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):  # changed, lost and added words
                k = rng.randrange(len(words))
                words[k:k + 1] = rng.choice([[], [rng.choice(noise)], [words[k], rng.choice(noise)]])
            if rng.random() < 0.3:
                words = words[:rng.randint(1, len(words))]
            parts += [rng.choice(noise) for _ in range(rng.randint(0, 40))] + words
        texts.append(" ".join(parts))
    got = [{x["name"] for x in found} for found in scanner.matches(Words(folded_words(pa.array(texts, pa.string()))))]
    want = [plain_notices(t, licenses.TEMPLATES) for t in texts]
    assert got == want and sum(map(len, want)) > 200


# ---- toxicity -----------------------------------------------------------------------------------------

def test_token_scores(spark):
    """Log-odds under the Dirichlet prior, significance, and the rate at which the mean of exp(rate * score) is 1."""
    rng = random.Random(2)
    counts = [(f"clean{k}", rng.randint(3, 400), rng.randint(0, 3)) for k in range(60)] + [(f"both{k}", n := rng.randint(20, 300), n // 6) for k in range(40)]
    counts += [(f"bad{k}", rng.randint(0, 6), rng.randint(15, 60)) for k in range(15)] + [("rare", 1, 1), ("\0clea", 500, 5), ("\0bad0", 2, 90)]
    scores, known, rate = toxicity.token_scores(spark.createDataFrame(counts, "token string, n0 long, n1 long"))
    used = [c for c in counts if c[1] + c[2] >= 3]
    t0, t1 = (float(sum(c[k] for c in used if c[0][0] != "\0")) for k in (1, 2))
    want = {}
    for token, n0, n1 in used:
        prior = (n0 + n1) * toxicity.PRIOR / (t0 + t1)
        odds = math.log((n1 + prior) / (t1 + toxicity.PRIOR - n1 - prior)) - math.log((n0 + prior) / (t0 + toxicity.PRIOR - n0 - prior))
        ratio = sum(n * math.log(n / ((n0 + n1) * t / (t0 + t1))) for n, t in ((n0, t0), (n1, t1)) if n)
        if math.sqrt(2 * max(ratio, 0.0)) >= toxicity.LEAST_Z:
            want[token] = min(max(odds + toxicity.DRIFT, -toxicity.LARGEST), toxicity.LARGEST)
    assert scores == pytest.approx(want) and known == {c[0] for c in used if c[1] + c[2] >= 8 and c[0][0] != "\0"}
    assert any(t.startswith("bad") for t in scores) and not any(t.startswith("both") for t in scores)
    clean = {c[0]: c[1] + 0.5 for c in used if c[0] in scores and c[0][0] != "\0"}
    rest = max(t0 - sum(clean.values()), 1.0)
    mean = lambda r: (sum(n * math.exp(r * scores[t]) for t, n in clean.items()) + rest * math.exp(r * toxicity.DRIFT)) / (sum(clean.values()) + rest)
    assert mean(rate) == pytest.approx(1, abs=1e-6) or rate == 0.05


def test_excess_of_passages():
    """rate * score - log K - log n of the best maximal segment, and the log of the sum of those above 0."""
    rng = random.Random(1)
    model = toxicity.Model({}, frozenset(), 0.7, 1.3)
    for _ in range(200):
        s = np.array([rng.choice([-0.5, -0.5, -2.0, 1.0, 3.0]) for _ in range(rng.randint(1, 60))])
        features, good = toxicity.summary(model, s)
        total = np.concatenate([[0], np.cumsum(s)])
        best = max((total[j] - total[i] for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        if best <= 0:
            assert features[0] == -10 and not good
            continue
        assert features[0] == pytest.approx(min(40, max(-10, 0.7 * best - 1.3 - math.log(max(2, len(s))))))
        excess = [0.7 * (total[b] - total[a]) - 1.3 - math.log(max(2, len(s))) for a, b, _ in good]
        assert all(x > 0 for x in excess) and features[1] == pytest.approx(math.log1p(sum(excess)))


def test_calibration_follows_clean_texts(spark):
    """log K is the mean of the best excess of clean texts less Euler's constant."""
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(["dull", "plain", "vile", "calm"] if k % 4 else ["vile", "foul", "nasty", "plain"]) for _ in range(40)), int(k % 4 == 0)) for k in range(240)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    raw = toxicity.Model(model.scores, model.known, model.rate, 0.0)
    import zlib
    best = []
    for k, t, y in rows:
        if zlib.crc32(str(k).encode()) % 5 and not y:
            x = toxicity.summary(raw, raw.of(pa.array(t.split())))[0][0]
            if x > -10:
                best.append(x)
    assert model.log_k == pytest.approx(sum(best) / len(best) - float(np.euler_gamma) if best else 0.0)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert all((got[k] >= 0.5) == bool(y) for k, _, y in rows)
