"""URL filters, vector codes and the filter audit against brute force."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest
from conftest import SF_SMALL
from llm_fixtures import WORD, empty, messy  # noqa: F401
from pyspark.sql import functions as F

from hourbook.llm import common, filter_audit, url_filters, vector_codes

# --- URL filters ---------------------------------------------------------------

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("example.org", "/en/12", "allow"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("b.com", "", "block"), ("a.b.com", "/x", "allow"), ("Com", "/de/x", "allow"),
    ("", "/q", "block"), ("net", "/p", "block"), ("net", "/p", "allow"), ("net", "/p", "allow"), ("dé.fr", "/", "block"), ("b.com", None, "block"),
]


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:stop]


def plain_verdict(url, rules, default):
    host, path = plain_split(url)
    best = None
    for rule_host, rule_path, verdict in rules:
        if rule_host is None or verdict is None:
            continue
        rule_host, rule_path = rule_host.lower(), rule_path or ""
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            best = max(best or (), (len(rule_host + rule_path), len(rule_host), rule_host + rule_path, verdict))
    return (host, path, best[2], best[3]) if best else (host, path, None, default)


def url_rows():
    rng = random.Random(5)
    hosts = ["org", "example.org", "www.example.org", "badexample.org", "a.b.com", "x.a.b.com", "b.com", "com", "COM", "net", "dé.fr", "w.dé.fr", "", ".", "a.", ".com", "com.", "com:80", "ex-ample.org"]
    paths = ["", "/", "/es/", "/es", "/es/a", "/en/1", "/en/12", "/en/123", "/en/2", "/fr/", "/de/", "/de/x", "/x", "/xy", "/q", "/p?x=/fr/", "?/de/", "#/", "/p#://a", "/ü"]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(500)]
    rows += [(500 + i, u) for i, u in enumerate([None, "", "nothing", "://", "a://", "x://y://z/fr/", "http:/com/fr/", "http://com/" + "fr/" * 30_000, "http://" + "a." * 3000 + "com/de/x"])]
    rows += [(None, "http://example.org/es/1"), (None, None), (7, "http://org/")] + [(1000 + i, "http://www.example.com/fr/same") for i in range(300)] + [(3, "http://b.com/")] * 3
    return rows


def judged(df):
    return sorted(map(tuple, df.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


@pytest.mark.parametrize("default", ["allow", "block"])
def test_urls_match_brute_force(spark, default):
    rows = url_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(5)
    for name in ("host", "path", "key", "point", "stack", "row", "open", "part", "idx", "tie", "rule", "verdict", "value"):
        pages = pages.withColumn(name, F.lit(1))
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("com", "/zz", None)], "host string, path string, verdict string")
    got = judged(url_filters.judge_urls(pages, rules, default))
    assert got == sorted(((i, *plain_verdict(u, RULES, default)) for i, u in rows), key=repr)


def test_many_nested_rules_over_many_ranges(spark):
    rng = random.Random(9)
    names = ["a", "b", "ab", "com"]
    rules = {(".".join(rng.choices(names, k=rng.randint(1, 4))), "/" + "".join(rng.choices("xy/", k=rng.randint(0, 6)))): rng.choice(["allow", "block"]) for _ in range(600)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    rows = [(i, "s://" + ".".join(rng.choices(names, k=rng.randint(1, 6))) + "/" + "".join(rng.choices("xy/", k=rng.randint(0, 8)))) for i in range(1500)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        frames = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
        assert judged(url_filters.judge_urls(*frames)) == sorted(((i, *plain_verdict(u, rules, "allow")) for i, u in rows), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_urls_without_pages_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert judged(url_filters.judge_urls(pages.limit(0), rules)) == []
    assert judged(url_filters.judge_urls(pages, rules.limit(0), "block")) == [(1, "a.com", "/x", None, "block")]
    with pytest.raises(ValueError):
        url_filters.judge_urls(pages, spark.createDataFrame([("a", "/", "maybe")], rules.schema))


# --- vector codes --------------------------------------------------------------


def plain_nearest(entries, parts):
    apart = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    return apart.argmin(1), apart.min(1)


@pytest.mark.parametrize(("count", "width", "spread"), [(64, 4, 30), (64, 1, 5), (7, 3, 10_000_000), (1, 4, 50), (64, 8, 2)])
def test_masks_find_the_nearest(count, width, spread):
    rng = np.random.default_rng(count * width)
    entries, parts = rng.integers(-spread, spread, (count, width)), rng.integers(-3 * spread, 3 * spread, (3000, width))
    parts[:count] = entries
    index, error = vector_codes.nearest(entries, parts)
    want, least = plain_nearest(entries, parts)
    assert (index == want).all() and (error == least).all()


def test_masks_with_equal_and_extreme_entries():
    entries = np.array([[5, 5], [5, 5], [-(1 << 27), 1 << 27], [0, 0]])
    parts = np.array([[5, 5], [4, 5], [1 << 27, -(1 << 27)], [-(1 << 27), 1 << 27], [0, 1]])
    index, error = vector_codes.nearest(entries, parts)
    want, least = plain_nearest(entries, parts)
    assert index.tolist() == want.tolist() and error.tolist() == least.tolist()


def plain_codes(rows, parts, entries, rounds, dims):
    def good(v):
        return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) <= vector_codes.LARGEST for x in v)

    kept = [(i, np.array([math.floor(256 * x) for x in v]), label) for i, v, label in rows if good(v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))[:entries]
    width = dims // parts
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def assigned():
        out = []
        for _, v, _ in kept:
            cut = [v[p * width : (p + 1) * width] for p in range(parts)]
            out.append([min((int(((x - e) ** 2).sum()), k) for k, e in enumerate(books[p])) for p, x in enumerate(cut)])
        return out

    for _ in range(rounds):
        chosen = assigned()
        for p in range(parts):
            for k in range(len(first)):
                own = [v[p * width : (p + 1) * width] for (_, v, _), c in zip(kept, chosen) if c[p][1] == k]
                if own:
                    books[p][k] = np.array([sum(int(x[d]) for x in own) // len(own) for d in range(width)])
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, label, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c)) for (i, _, label), c in zip(kept, assigned())]
    sums = {}
    for _, label, _, e in coded:
        sums[label] = sums.get(label, 0) + e
    return sorted(((i, code, e, sums[label], digest) for i, label, code, e in coded), key=repr)


def vectors():
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], rng.choice([0, 1, 2, None, 7])) for i in range(400, 0, -1)]
    rows += [(1000 + i, rows[9][1], 5) for i in range(250)]
    odd = [None, [], [0.1] * 7, [0.1] * 7 + [None], [0.1] * 7 + [math.nan], [math.inf] * 8, [1e30] * 8, [-0.0] * 8, [1e5] * 8, [-1e5, 1e5] * 4]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)]
    return rows + [(None, [0.5] * 8, None), (None, [0.25] * 8, 3), (3, [0.3] * 8, 4), rows[20], rows[20]]


@pytest.mark.parametrize(("parts", "entries"), [(4, 64), (2, 5), (8, 64)])
def test_codes_match_brute_force(spark, parts, entries):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(7)
    for name in ("code", "error", "n", "vector", "_label", "label_error", "dims"):
        df = df.withColumn(name, F.lit("x"))
    got = vector_codes.compress(df, parts, entries).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(rows, parts, entries, 2, 8)


def test_codes_of_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    one = spark.createDataFrame([(4, [0.5] * 16, None)], schema)
    (row,) = vector_codes.compress(one).collect()
    assert (row["code"], row["error"], row["label_error"]) == ("00" * 16, 0, 0)
    assert vector_codes.compress(one.limit(0)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.compress(one, parts=3)
    with pytest.raises(ValueError):
        vector_codes.compress(one, entries=65)


def test_hot_keys_are_joined_apart(spark):
    rows = common.stored(spark.range(900).selectExpr("id", "if(id % 3 = 0, null, if(id < 300, -1, id)) AS k"), "t")
    totals = common.stored(rows.groupBy("k").agg(F.sum("id").alias("total"), F.count("*").alias("n")), "t")
    got = common.join_spread(rows, totals, ["k"], "n")
    assert got.columns == ["id", "k", "total"]
    want = {r["k"]: r["total"] for r in totals.collect()}
    found = got.collect()
    assert len(found) == 900 and all(r["total"] == want[r["k"]] for r in found)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower()


# --- filter audit --------------------------------------------------------------


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if i is not None and i > least[text]:
            fails.add("E")
        rows.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shares, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] and bool(r[1] & set(order[: step - 1])) for r in own)
                left = [r for r in left if f not in r[1]]
                shares[f] += len(gone)
                lines.append([part, "".join(order), step, len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        out += [(*line[:-1], shares[line[-1]]) for line in lines]
    return sorted(out)


FIGURES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def found_audit(docs, labels):
    return sorted(map(tuple, filter_audit.audit(docs, labels).select(*FIGURES).collect()))


LABELS = "doc_id long, quality int, toxic int"


def test_audit_matches_brute_force(spark, messy):
    rng = random.Random(4)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 110)] + [(5, 1, 0), (None, 1, 1), (103, 1, 1), (9999, 1, 1)]
    marked = spark.createDataFrame([(300 + i, "MANY CAPITALS & marks " * (i % 50), "en" if i % 2 else "", None, None) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = messy.unionByName(marked, allowMissingColumns=True)
    for name in ("part", "bits", "digest", "n", "good", "toxic", "quality", "first", "body"):
        docs = docs.withColumn(name, F.lit(3))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    extra = spark.createDataFrame(labels, LABELS).withColumn("part", F.lit("x"))
    assert found_audit(docs, extra) == plain_audit(rows, labels)


def test_audit_of_hot_copies_and_of_nothing(spark, empty):
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0)], LABELS)
    rows = [(i, "same text" if i % 3 else f"text {i}", "en") for i in range(600)] + [(1, "same text", "en"), (1, "same text", "de"), (None, "same text", None)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert found_audit(docs, labels) == plain_audit(rows, [(7, 1, 1), (8, 1, 0)])
    assert found_audit(docs, labels.limit(0)) == plain_audit(rows, [])
    assert found_audit(empty, labels) == []


def test_contraction_is_a_sum_over_cells():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 9, (3, 2, 2, 2, 2))
    selectors = rng.integers(0, 2, (11, 3, 2))
    got = filter_audit.contract(cells, selectors)
    for s, chosen in enumerate(selectors):
        want = sum(cells[:, :, a, b, c] * chosen[0, a] * chosen[1, b] * chosen[2, c] for a in (0, 1) for b in (0, 1) for c in (0, 1))
        assert (got[:, :, s] == want).all()


def test_new_queries_keep_their_columns(spark):
    from hourbook.llm.queries import QUERIES

    wanted = {
        "op11_url_filters": ["page_id", "host", "path", "rule", "verdict"],
        "op12_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
        "op13_filter_audit": FIGURES,
    }
    for name, columns in wanted.items():
        assert QUERIES[name](spark, SF_SMALL).columns == columns
