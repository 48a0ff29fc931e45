"""Operators that are DataFrame expressions only: secrets, quality rules, URL filters, mixing."""

import datetime as dt
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventscope.llm import mixing, quality_rules, queries, secrets, url_filters
from tests import oracle

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    oracle.same(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLE_SQL[name])


# ---- secrets ---------------------------------------------------------------------------------

# The rules of the contract as they are stated.
STATED = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def brute_spans(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(STATED) for m in p.finditer(text or "") if ok(m)]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


TEXTS = [
    None, "", "nothing here", "é password = 'abcdef' ñ secret:xy token=zzzzzzz", "PASSWORD\":  \"Ab+/=._-1\"", "secret=token=abcdefgh", "secret=token: abcdefgh", "api_key=123456 apikey: 1234567 api-key=1234567",
    "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "x" + "0123456789abcdef" * 2 + "g" + "f" * 23, "AKIAAKIA" + "C" * 12, "token=" + "0" * 30, "\U0001f600 secret='" + "f" * 24, "secret = abcdef" * 400, "tokentokentoken=abcdef",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20,
    "a -----BEGIN PRIVATE KEY-----\nMIIBVQIBADANBgkq+/\nhki=\n-----END PRIVATE KEY----- b", "-----BEGIN OPENSSH PRIVATE KEY-----\n" + "MIIBVQIBADANBgkq\n" * 3 + "plain words after a key without an end",
]


def test_secrets_equal_the_stated_rules(spark):
    docs = spark.createDataFrame([(i % 15, t) for i, t in enumerate(TEXTS)] + [(None, "token=abcdefg"), (3, TEXTS[3])], DOCS)
    got = secrets.digest(secrets.scan(docs)).collect()
    want = sorted((i, len(s), hashlib.sha256(",".join(s).encode()).hexdigest()) for i, s in [(i % 15, brute_spans(t)) for i, t in enumerate(TEXTS)] + [(-1, brute_spans("token=abcdefg")), (3, brute_spans(TEXTS[3]))])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_assign"] + r["n_access"] + r["n_hex"], r["base_sha256"]) for r in got) == want
    spans = {r["spans"] for r in got}
    assert "private_key:0:31" in spans and "private_key:2:79" in spans and "private_key:0:86" in spans and "host_token:0:44,hex:4:44" in spans


def test_joined_candidates_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), DOCS)
    small = sorted(secrets.digest(secrets.scan(docs)).collect())
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", 0)
    assert sorted(secrets.digest(secrets.scan(docs)).collect()) == small


def test_trigram_queries():
    assert secrets.trigram_query(r"AKIA[A-Z0-9]{16,}") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query(r"[0-9a-f]{24,}") is None
    assert secrets.trigram_query(r"ab?c") is None
    assert set(secrets.trigram_query(r"abc|wxyz")) == {frozenset({"abc"}), frozenset({"wxy", "xyz"})}
    assert secrets.trigram_query(r"(abc)+.*def") == [frozenset({"abc", "def"})]


def test_queries_hold_for_every_match(spark):
    import random

    rng = random.Random(5)
    for pattern, alphabet in ((r"ab(c|de)f[gh]i*jkl", "abcdefghijkl"), (r"(foo|ba[rz])_?qux\d{2}", "fobarzqux_1")):
        query = secrets.trigram_query(pattern)
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(30))
            if re.search(pattern, text):
                assert any(all(t in text for t in part) for part in query)
        assert any(all(t in "abdefhiijkl foo_qux11" for t in part) for part in query)


def brute_redact(text, spans):
    out, at = "", 0
    for start, _, kind, end in spans:
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]


def test_many_matches_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 50)
    base = " ".join(["é token=abcdef", "AKIA" + "Z" * 16, "\U0001f600 secret: " + "0f" * 13, "tokentoken=" + "ab" * 20] * 120)
    texts = [base, base + " end", "token=" + "a" * 300 + " x", "secret=abcdef", "x secret=abcdef", base[:333], None, "y" * 60]
    docs = spark.createDataFrame([(k, t, "mine", "own") for k, t in enumerate(texts)], DOCS + ", secret_kinds string, `raw.x` string")
    scanned = secrets.scan(docs)
    assert scanned.columns == [*docs.columns, "secrets"]
    got = {r["doc_id"]: r for r in scanned.collect()}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(scanned).collect()}
    for k, t in enumerate(texts):
        want = sorted((m.start(), n, kind, m.end()) for n, (kind, p, ok) in enumerate(STATED) for m in p.finditer(t or "") if ok(m))
        assert [tuple(s) for s in got[k]["secrets"] if s["kind"] in dict((x, 1) for x, _, _ in STATED)] == want
        assert clean[k] == (brute_redact(t, [tuple(s) for s in got[k]["secrets"]]) if t and got[k]["secrets"] else t)


def test_running_sums_and_tops(spark):
    from eventscope.llm.common import RUN, running

    rows = [(list(map(int, np.random.default_rng(n).integers(0, 50, n))),) for n in (0, 1, RUN - 1, RUN, RUN + 1, 5 * RUN + 3)] + [(None,)]
    df = spark.createDataFrame(rows, "v array<int>")
    for r in df.select("v", running(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), running(F.col("v"), F.greatest, F.lit(0)).alias("m")).collect():
        assert r["s"] == np.cumsum(r["v"] or []).tolist() and r["m"] == np.maximum.accumulate(r["v"] or [0])[: len(r["v"] or [])].tolist()


def test_redaction_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a secret=abcdef b AKIA" + "Z" * 16, "own"), (2, "clean", "own"), (3, None, None)], DOCS + ", kinds string")
    got = {r["doc_id"]: r for r in secrets.redact(secrets.scan(docs)).collect()}
    assert got[1]["text"] == "a [assign] b [access]" and got[2]["text"] == "clean" and got[3]["text"] is None
    assert got[1]["kinds"] == "own"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS + ", source string")
    assert secrets.digest(secrets.scan(docs)).count() == 0
    assert quality_rules.digest(quality_rules.judge(docs)).count() == 0
    assert mixing.digest(docs).count() == 0 and mixing.mix(docs).count() == 0


# ---- quality rules ---------------------------------------------------------------------------


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = [None, "", " \t\n", "a b", "a b c", "a b c a b c a", "x\nx\n x\n\n \nx", "ä|# <b>\x0b\x0cé\r\n", "w " * 120, "one two three four " * 30, " no break space"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a b c"), (4, "a b c")], DOCS)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in quality_rules.digest(quality_rules.judge(docs)).collect())
    assert got == sorted([(i, brute_quality(t)) for i, t in enumerate(texts)] + [(-1, brute_quality("a b c")), (4, brute_quality("a b c"))])


def test_quality_of_long_texts_and_clashing_columns(spark):
    texts = ["one two three " * 30_000, " ".join(f"w{i}" for i in range(60_000)), "x" * 300_000, "a\n" * 50_000]
    docs = spark.createDataFrame([(k, t, "mine", 1) for k, t in enumerate(texts)], DOCS + ", raw_measures string, __w int")
    judged = quality_rules.judge(docs)
    assert judged.columns == [*docs.columns, "measures", "base_failed", "failed_rules", "kept"]
    got = {r["doc_id"]: r for r in judged.collect()}
    assert all(r["raw_measures"] == "mine" and r["__w"] == 1 for r in got.values())
    assert [(got[k]["measures"]["n_words"], got[k]["measures"]["n_repeat_words"], got[k]["measures"]["n_dup_lines"]) for k in range(4)] == [(90_000, 90_000, 0), (60_000, 0, 0), (1, 0, 0), (50_000, 50_000, 49_999)]


def test_quality_verdicts(spark):
    clean = " ".join(f"word{chr(97 + i % 26)}{i} the" for i in range(60))
    junk = " ".join(f"word{i}%% the##" for i in range(60))
    rows = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame([(1, clean), (2, junk), (3, "short text")], DOCS)).collect()}
    assert rows[1]["kept"] and not rows[1]["base_failed"]
    assert not rows[2]["kept"] and "symbol_ratio" in rows[2]["failed_rules"]
    assert rows[3]["base_failed"]


# ---- URL filters -----------------------------------------------------------------------------


def test_url_filter_against_brute_force(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    events = [("bad.com", day(5), "add"), ("bad.com", day(40), "remove"), ("bad.com", day(90), "add"), ("sub.bad.com", day(0), "add"), ("Ads.net", day(10), "add"), ("ads.net", day(10), "remove"), ("ads.net", day(12), "add"), ("ads.net", day(12), "add"), (None, day(1), "add"), ("x.org", None, "add")]
    urls = ["http://bad.com/a", "https://u:p@www.SUB.bad.com:8080/x?y#z", "http://notbad.com", "ftp://ads.net.", None, "", "no url", "https://com/"]
    rows = [(k, u, None if k % 17 == 3 else day(k * 7 % 120), "kept") for k in range(160) for u in [urls[k % len(urls)]]]
    captures = spark.createDataFrame(rows, "page_id long, url string, day date, suffix string")
    listed = spark.createDataFrame(events, "entry string, day date, action string")
    got = {r["page_id"]: (r["blocked"], r["entry"], r["listed_on"]) for r in url_filters.judge(captures, listed).collect()}

    def active(entry, on):
        states = {}
        for e, d, a in events:
            if e and d and e.lower() == entry and d <= on:
                states.setdefault(d, []).append(a)
        if not states:
            return None
        last = max(states)
        return last if all(a == "add" for a in states[last]) else None

    hosts = {"http://bad.com/a": "bad.com", "https://u:p@www.SUB.bad.com:8080/x?y#z": "www.sub.bad.com", "http://notbad.com": "notbad.com", "ftp://ads.net.": "ads.net", "https://com/": "com"}
    for k, u, on, _ in rows:
        host, want = hosts.get(u), (False, None, None)
        if host and on:
            labels = host.split(".")
            for i in range(len(labels)):
                entry = ".".join(labels[i:])
                if active(entry, on):
                    want = (True, entry, active(entry, on))
                    break
        assert got[k] == want, (k, u, on)


def test_url_filter_with_clashing_columns_and_repeated_rows(spark):
    day = dt.date(2024, 1, 9)
    rows = [(1, "http://a.bad.com/x", day), (1, "http://a.bad.com/x", day), (2, "http://good.com/", day)]
    names = ("__host", "__day", "other_host", "OTHER_DAY", "suffix", "bucket", "valid_from", "lengths", "host")
    captures = spark.createDataFrame(rows, "page_id long, url string, day date").withColumns({c: F.lit("mine") for c in names})
    listed = spark.createDataFrame([("bad.com", dt.date(2024, 1, 1), "add")], "entry string, day date, action string")
    got = url_filters.judge(captures, listed)
    assert sorted((r["page_id"], r["host"], r["blocked"]) for r in got.collect()) == [(1, "a.bad.com", True)] * 2 + [(2, "good.com", False)]
    assert set(captures.columns) <= set(got.columns) and got.filter("__host = 'mine' and __day = 'mine' and other_host = 'mine'").count() == 3


def test_url_filter_of_long_hosts(spark, monkeypatch):
    day, deep = dt.date(2024, 1, 9), ".".join(["x"] * 10_000)
    rows = [(1, f"http://{deep}.bad.com/", day), (2, f"http://{deep}.com/", day), (3, "http://" + "y" * 100_000 + ".org/", day), (4, f"http://{'a.' * 300}long.net", day)]
    captures = spark.createDataFrame(rows, "page_id long, url string, day date")
    listed = spark.createDataFrame([(e, dt.date(2024, 1, 1), "add") for e in ("bad.com", "y" * 100_000 + ".org", "a." * 200 + "long.net")], "entry string, day date, action string")
    want = [(1, True), (2, False), (3, True), (4, True)]
    assert sorted((r["page_id"], r["blocked"]) for r in url_filters.judge(captures, listed).collect()) == want
    monkeypatch.setattr(url_filters, "BROADCAST_ENTRIES", 0)
    assert sorted((r["page_id"], r["blocked"]) for r in url_filters.judge(captures, listed).collect()) == want


def test_url_filter_without_events_or_captures(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", dt.date(2024, 1, 1))], "page_id long, url string, day date")
    listed = spark.createDataFrame([], "entry string, day date, action string")
    assert [r["blocked"] for r in url_filters.judge(captures, listed).collect()] == [False]
    assert url_filters.judge(captures.limit(0), listed).count() == 0


# ---- mixing ----------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def test_mix_targets_and_copies(spark):
    rows = [(i, "w " * (i % 7 + 1), s) for i in range(400) for s in [("a", "b", None, "é", "Z")[0 if i % 3 == 0 else i % 5]]] + [(None, "x y", "a"), (7, None, "b"), (7, "x y", "b")]
    docs = spark.createDataFrame(rows, DOCS + ", source string")
    got = mixing.digest(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    by = dict(zip([s for s in {r[2] for r in rows}], [0] * 9))
    source = mixing.copies(docs).select("source", "target", "copies", "size").collect()
    assert all(r["target"] == pytest.approx(want[r["source"]]) for r in source)
    for r in source:
        by[r["source"]] += r["copies"] * r["size"]
    assert all(abs(by[s] - want[s]) <= 0.3 * want[s] for s in by)
    assert all(r["taken"] <= 2 * r["size"] for r in got) and sorted(map(str, got)) == sorted(map(str, mixing.digest(docs).collect()))


def test_sizes_of_long_texts(spark):
    docs = spark.createDataFrame([(1, "w " * 400_000, "a"), (2, "x" * 500_000, "b")], DOCS + ", source string")
    assert sorted((r["doc_id"], r["size"]) for r in mixing.digest(docs).collect()) == [(1, 400_000), (2, 1)]


def test_mix_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", "mine", 5) for i in range(20)], DOCS + ", source string, copies string, size long")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {(r["copies"], r["size"]) for r in mixed.collect()} == {("mine", 5)}
    assert mixed.count() == mixing.copies(docs).agg(F.sum("copies")).first()[0]
