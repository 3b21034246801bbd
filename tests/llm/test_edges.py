"""Cases that only the methods catch, clashing names, and long values."""

import math
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.llm import quality as q
from cartolith.llm import url_filter as u
from cartolith.llm.decontaminate import decontaminate
from cartolith.llm.jaccard_join import one_of_each
from cartolith.llm.mixing import mixed_documents
from cartolith.llm.pii import pii, redact
from cartolith.llm.secret_scan import ALLOW, secret_scan, suspicious


def test_secret_patterns_do_not_recurse(spark):
    texts = {1: "a/" * 60_000 + "abcdefghijklmnop1", 2: "x_-" * 60_000, 3: "/" * 60_000, 4: "Ab1/" * 30_000, 5: "=" * 60_000, 6: "a" * 60_000}
    got = {r.doc_id: r for r in secret_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(got) == 6 and got[6].n_hex == 1 and got[1].n_assign == 0
    assert all("++" in p or "+" not in p for p in ALLOW if "(?:" in p)


def test_planted_secrets(spark):
    rng = random.Random(3)
    token = "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(40))
    letters = "".join(rng.sample(string.ascii_lowercase, 24))
    texts = {1: f"key {token} end", 2: f"word {letters} end", 3: "the-quick-brown-fox-jumps-over it", 4: "12345678901234567890123", 5: "internationalisations antidisestablishmentarianism"}
    got = {r.doc_id: r.n_entropy for r in secret_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert spark.range(1).select(suspicious(F.lit("sha256-" + token))).first()[0] is False


def test_planted_identifiers(spark):
    """Cards teach the word before them, that word and shape a number without a valid check digit, and its own context the next one."""
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0
    numbers = [n for n in (f"41111111111{k:05d}" for k in range(3000))]
    good, bad = [n for n in numbers if luhn(n)][:60], [n for n in numbers if not luhn(n)][:12]
    rows = [(i, f"please charge card {n} today") for i, n in enumerate(good)]
    rows += [(100 + i, f"please charge card {n} today") for i, n in enumerate(bad)]
    # the found ones also follow another word, which no seed does
    rows += [(200 + i, f"the holder {n} signed") for i, n in enumerate(bad)] + [(300 + i, f"the holder 52222222222{i:05d} signed") for i in range(3)]
    rows += [(400, "card 12 of 2024"), (401, None)]
    got = {r.doc_id: r for r in pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_card == 1 and got[i].n_found == 0 for i in range(60))
    assert all(got[100 + i].n_card == 0 and got[100 + i].spans == "found:19:35" for i in range(12))
    assert all(got[200 + i].n_found == 1 for i in range(12)) and sum(got[300 + i].n_found for i in range(3)) == 3
    assert got[400].n_found == 0


def test_beta_quantile(spark):
    cases = [(1.0, 1.0), (2.5, 0.7), (40.0, 3.0), (900.0, 100.0), (0.5, 30.0)]

    def cdf(x, a, b, n=200_000):
        s = (np.arange(n) + 0.5) / n
        t = s * s  # takes the sting out of the ends
        density = 2 * s * np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)))
        return float(density[t <= x].sum() / density.sum())

    d = spark.createDataFrame(cases, "a double, b double").select("a", "b", u.lower_bound(F.col("a"), F.col("b"), 1.645).alias("q"), u.beta_cdf(F.lit(0.3), F.col("a"), F.col("b")).alias("c"))
    for r in d.collect():
        assert cdf(r.q, r.a, r.b) == pytest.approx(0.05, abs=3e-3)
        assert cdf(0.3, r.a, r.b) == pytest.approx(r.c, abs=3e-3)


def test_planted_hosts(spark):
    rows, outcomes = [], []
    for k in range(400):
        host, good = ("bad.example.net", 0) if k < 60 else ("new.bad.example.net:8080", 0) if k < 65 else (f"h{k % 12}.site{k % 5}.net", 1)
        rows.append((k, f"http://{host}/p/{k}"))
        if k not in (59, 64):
            outcomes.append((k, good))
    rows += [(900, "http://other.site1.net/x"), (901, "http://user@h0.site0.net.:80/y"), (902, None), (903, "http://h0.site0.net/" + "u" * 100_000)]
    pages = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, site string")
    got = {r.page_id: r for r in u.url_filter(pages, spark.createDataFrame(outcomes, "page_id long, good int")).collect()}
    assert got[59].verdict == got[64].verdict == "block"
    assert got[900].verdict == got[901].verdict == got[903].verdict == "allow" and got[901].bound == got[903].bound
    assert len(got) == len(rows) and u.url_filter(pages.where("false"), spark.createDataFrame([], "page_id long, good int")).count() == 0


def test_reputation_by_hand(spark):
    """Bounds of three levels computed again in plain Python."""
    rng = random.Random(8)
    rows = [(f"h{rng.randrange(6)}.d{rng.randrange(3)}.net", int(rng.random() < 0.6)) for _ in range(300)]

    def level(groups, means, floor=2.0):
        over = sum((g - n * means[k]) ** 2 - n * means[k] * (1 - means[k]) for k, (g, n) in groups.items())
        most = sum(n * (n - 1) * means[k] * (1 - means[k]) for k, (g, n) in groups.items())
        s = max(floor, 1 / min(0.99, max(0.001, over / most)) - 1)
        return {k: (means[k] * s + g, (1 - means[k]) * s + n - g) for k, (g, n) in groups.items()}

    def sums(key):
        out = {}
        for h, g in rows:
            a, n = out.get(key(h), (0, 0))
            out[key(h)] = a + g, n + 1
        return out

    mean = lambda ab: ab[0] / sum(ab)
    whole = (sum(g for _, g in rows) + 1) / (len(rows) + 2)
    suffix = level(sums(lambda h: "net"), {"net": whole})
    domain = level(sums(lambda h: h.split(".", 1)[1]), {h.split(".", 1)[1]: mean(suffix["net"]) for h, _ in rows})
    host = level(sums(lambda h: h), {h: mean(domain[h.split(".", 1)[1]]) for h, _ in rows})
    want = spark.createDataFrame([(h, *ab) for h, ab in host.items()], "host string, a double, b double").select("host", u.lower_bound(F.col("a"), F.col("b"), 1.645).alias("w"))
    got = u.reputations(spark.createDataFrame(rows, "host string, good int"), 1.645)[0].join(want, "host").collect()
    assert len(got) == len(host) and all(r.by_host == pytest.approx(r.w, abs=1e-9) for r in got)


CLASH = ["row", "key", "row_key", "mark", "copy", "copies", "spans", "_key", "_id", "_n", "rows"]


def clashing(spark):
    text = "one two three four five six seven eight mail a@b.cc"
    rows = [(1, text, "en", "s"), (2, text, "en", "s"), (None, text, None, None), (4, "other words here that nobody else has 1.2.3.4", "fr", "t"), (5, None, "fr", "t"), (6, "", "fr", "t")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for i, c in enumerate(CLASH):
        d = d.withColumn(c, F.lit(i))
    return d


def sound(d, columns):
    assert d.columns == columns
    rows = d.collect()
    assert all([r[c] for c in CLASH] == list(range(len(CLASH))) for r in rows)
    return rows


def test_clashing_names(spark):
    d = clashing(spark)
    assert sorted(str(r.doc_id) for r in sound(one_of_each(d), d.columns)) == ["1", "4", "5", "6", "None"]
    assert sum("<email>" in (r.text or "") for r in sound(redact(d), d.columns)) == 3
    mixed = sound(mixed_documents(d), [*d.columns, "copy_"])
    assert len(mixed) > 0 and {r.copy_ for r in mixed} <= {1, 2}
    bench = spark.createDataFrame([(1, "other words here that nobody else has")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in sound(decontaminate(d, bench), d.columns)) == ["1", "2", "5", "6", "None"]
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert {str(r.doc_id) for r in sound(q.good_documents(d, labels), d.columns)} <= {"1", "2", "4", "None"}


def test_perplexity_by_hand(spark):
    """Counts, discounts, blending and scores of a small corpus computed again in plain numpy."""
    rng = random.Random(5)
    say = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(40))
    docs = [(i, "aa" if i % 3 else "bb", say("abcdeé" if i % 3 else "uvwxyzж")) for i in range(60)] + [(100, "cc", say("abc")), (101, None, "zz zz"), (102, "aa", None)]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in q.quality(d, labels).collect()}
    counts = {}
    for i, lang, text in docs[:50]:
        for key in (lang, q.ALL):
            counts.setdefault(key, np.zeros(q.SYMBOLS**q.ORDER))
            np.add.at(counts[key], q.grams([text])[0], 1)
    own = {k: q.kneser_ney(c) for k, c in counts.items()}
    mean = {k: float((c * own[k]).sum() / c.sum()) for k, c in counts.items()}
    for i, lang, text in docs:
        model = lang if lang in own else q.ALL
        share = counts[model].sum() / (counts[model].sum() + q.PRIOR_CHARS)
        surprise = -np.log(share * np.exp(-own[model]) + (1 - share) * np.exp(-own[q.ALL]))
        assert got[i].model == model
        if text is None:
            assert got[i].perplexity is None and not got[i].keep
        else:
            score = (surprise[q.grams([text])[0]].sum() + q.PRIOR * mean[model]) / (len(text) + q.PRIOR)
            assert got[i].perplexity == pytest.approx(math.exp(score), rel=2e-3)
    again = q.quality(d.unionByName(d.where("doc_id = 7")), labels).where("doc_id = 7").collect()
    assert len(again) == 2 and again[0].perplexity == again[1].perplexity
