"""Hard negatives and url filters against brute force."""
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.llm import hard_negatives as H, url_filters as U
from checks.compare import compare, connect

SF = "/root/testdata/sf0.01"


def mined_by_hand(rows, anchors, count=5):
    """rows: (id, label, whole-number vector) with ids of their own."""
    out = set()
    for a, la, xa in rows:
        if not anchors(a):
            continue
        score = {i: sum(p * q for p, q in zip(x, xa)) for i, _, x in rows if i != a}
        label = {i: l for i, l, _ in rows}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == la][:count]:
            fine = [i for i in order if label[i] != la and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(fine[:count])}
    return out


def told(df):
    rows = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed,block,words", [(0, 40, 4), (1, 1000, 8), (2, 7, 2)])
def test_negatives_equal_brute_force(spark, seed, block, words):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 10))
    data = [(i, int(r.integers(0, 3)), (centres[r.integers(0, 6)] + r.normal(size=10) * 0.3).tolist()) for i in range(400)]
    data += [(1000 + i, i % 3, data[7][2]) for i in range(60)]         # many equal vectors: ties and a hot cell
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>")
    got = told(H.hard_negatives(df, F.col("id") % 20 == 0, block=block, words=words))
    whole = [(i, l, [math.floor(256 * e) for e in x]) for i, l, x in data]
    want = mined_by_hand(whole, lambda i: i % 20 == 0)
    assert got == want and len(want) > 100


def test_negatives_of_odd_rows(spark):
    big, nan, inf = [1e6] * 4, [math.nan, 1.0], [math.inf, 1.0]
    data = [(0, 1, [1.0, 2.0]), (100, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 2, [0.9, 2.0]), (3, 2, [1.0, 1.9, 5.0]),
            (4, None, [1.0, 2.0]), (None, 2, [1.0, 2.0]), (5, 2, None), (6, 2, nan), (8, 2, inf), (9, 2, [None, 1.0]),
            (10, 2, []), (11, 1, []), (200, 3, [0.0, 0.0]), (12, 3, [0.0, 0.0]), (13, 4, [-1.0, 0.5])]
    kind = "vec_id long, label int, embedding array<double>"
    df = spark.createDataFrame(data, kind).withColumns({c: F.lit(1) for c in ("uid", "id", "x", "cell", "block", "pack", "tops")})
    rows = [(i, l, [math.floor(256 * e) for e in x]) for i, l, x in data if None not in (i, l, x)
            and all(e is not None and math.isfinite(e) for e in x)]
    got = told(H.hard_negatives(df, F.col("id") % 100 == 0))
    assert got == mined_by_hand(rows, lambda i: i % 100 == 0) and len(got) > 5
    assert H.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0
    wide = spark.createDataFrame([(0, 1, big), (1, 1, big), (2, 2, big), (3, 2, [1e6, 1e6, 1e6, 9e5])], kind)
    x = 256 * 10 ** 6
    assert told(H.hard_negatives(wide, F.col("id") == 0)) == {(0, 1, 1, 2, 4 * x * x, 4 * x * x), (0, 1, 2, 3, 4 * x * x, 3 * x * x + x * x // 10 * 9)}
    twice = spark.createDataFrame([(0, 1, [1.0]), (0, 1, [1.0]), (1, 2, [1.0]), (1, 2, [1.0])], kind)
    assert sorted(map(tuple, H.hard_negatives(twice, F.col("id") == 0).collect())) == sorted(
        [(0, 0, k, 1, 65536, 65536) for k in (1, 2)] * 2)


def test_negatives_equal_sql(spark):
    ok, note = compare(spark, connect(SF), H.op11_hard_negatives, H._SQL, SF)
    assert ok, note


def test_search_stops_early_and_misses_nothing():
    r = np.random.default_rng(5)
    x = np.floor(256 * (np.repeat(r.normal(size=(40, 8)) * 4, 50, 0) + r.normal(size=(2000, 8)) * 0.1))
    books = [H.fit_words(h, 16, 10, 0) for h in (x[:, :4], x[:, 4:])]
    labels, ids = np.arange(2000) % 2, np.arange(2000)
    block = H.Block(ids, ids, labels, x, books)
    looked = 0
    for a in range(0, 2000, 100):
        score = (x @ x[a]).astype(np.int64)
        want = sorted((-int(score[i]), i, i) for i in ids if i != a and labels[i] == labels[a])[:5]
        assert block.positives(x[a], a, labels[a], 5) == want
        for bound, rows in block.visit(x[a]):
            if bound < -want[-1][0]:
                break
            looked += 0 if rows is None else rows[1] - rows[0]
    assert looked < 0.6 * 20 * 2000


# ---- url filters ----

def url_parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_by_hand(host, path, rules):
    fits = [(len(h + p), -k) for k, (_, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return rules[-max(fits)[1]] if fits else None


def template_by_hand(paths, least, share, alpha):
    """{path: template} of the {path: (n, bad, good)} of a host."""
    out, reach = {}, math.sqrt(0.5 * math.log(2 / alpha))

    def clean(s):
        return s.replace("%", "%25").replace("*", "%2A").replace("{", "%7B").replace(",", "%2C")

    def traits(rows):
        t = [sum(paths[p][0] for p, _ in rows)]
        for test in (lambda r: len(r) == 1, lambda r: len(r) > 1 and r[1] == "",
                     lambda r: len(r) > 1 and re.fullmatch("[0-9]+", r[1]), lambda r: len(r) > 1 and re.fullmatch("[A-Za-z]+", r[1])):
            t.append(sum(paths[p][0] for p, r in rows if test(r)))
        return t + [sum(paths[p][k] for p, _ in rows) for k in (1, 2)]

    def grow(node, rows):
        for p, r in rows:
            if not r:
                out[p] = node
        rows = [(p, r) for p, r in rows if r]
        total = sum(paths[p][0] for p, _ in rows)
        if not rows:
            return
        if total < least:
            out.update({p: node + "/**" for p, _ in rows})
            return
        common = 0
        while all(len(r) > common and r[common] == rows[0][1][common] for _, r in rows):
            common += 1
        if common:
            grow(node + "/" + "/".join(map(clean, rows[0][1][:common])), [(p, r[common:]) for p, r in rows])
            return
        values, wild = {}, {}
        for p, r in rows:
            values.setdefault(r[0], []).append((p, r))
        named = {}
        for seg, own in values.items():
            n = sum(paths[p][0] for p, _ in own)
            if n >= least and n >= share * total:
                named[clean(seg)] = own
            else:
                m = re.search(r"(\.[A-Za-z][A-Za-z0-9]{0,4})$", seg)
                wild.setdefault(m.group(1) if m else "", []).extend(own)
        for ending, own in wild.items():
            keep = sum(paths[p][0] for p, _ in own) >= share * total
            named.setdefault("*" + (ending if keep else ""), []).extend(own)
        groups = []
        for name, own in sorted(named.items(), key=lambda x: (-traits(x[1])[0], x[0])):
            t = traits(own)
            for g in groups:
                lead = g[0]
                if all(abs(x / lead[0] - y / t[0]) <= reach * (lead[0] ** -0.5 + t[0] ** -0.5) for x, y in zip(lead[1:], t[1:])):
                    g[1].append(name)
                    g[2].extend(own)
                    break
            else:
                groups.append((t, [name], list(own)))
        for _, names, own in groups:
            label = names[0] if len(names) == 1 else "{" + ",".join(sorted(names)) + "}"
            grow(node + "/" + label, [(p, r[1:]) for p, r in own])

    grow("", [(p, p[1:].split("/") if p else []) for p in paths])
    return out


def judged_by_hand(rows, rules, labels=None, least=U.LEAST):
    """[(id, host, path, rule, verdict, template)] of (id, url) rows."""
    seen = {}
    for k, (i, url) in enumerate(rows):
        host, path = url_parts(url)
        rule = rule_by_hand(host, path, rules)
        label = labels[k] if labels is not None else None if rule is None else int(rule[0] == "block")
        own = seen.setdefault(host, {}).setdefault(path, [0, 0, 0])
        own[0] += 1
        own[1] += label == 1
        own[2] += label == 0
    bad, good = (sum(v[j] for h in seen.values() for v in h.values()) for j in (1, 2))
    prior, out, where, purity = (bad + 1) / (bad + good + 2), [], {}, {}
    for host, paths in seen.items():
        where[host] = template_by_hand(paths, least, U.SHARE, U.ALPHA)
        for path, t in where[host].items():
            own = purity.setdefault((host, t), [0, 0])
            own[0] += paths[path][1]
            own[1] += paths[path][2]
    for i, url in rows:
        host, path = url_parts(url)
        rule = rule_by_hand(host, path, rules)
        b, g = purity[host, where[host][path]]
        own = "block" if (b + U.PRIOR_ROWS * prior) / (b + g + U.PRIOR_ROWS) >= U.PURITY else "allow"
        out.append((i, host, path, rule and rule[1] + rule[2], rule[0] if rule else own, where[host][path]))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


COLS = ["page_id", "host", "path", "rule", "verdict", "template"]


def test_pages_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()]
    got = [tuple(r) for r in U.op13_url_filters(spark, SF).select(COLS).collect()]
    assert order(got) == order(judged_by_hand(rows, U.RULES))


def test_templates_spread_labels(spark):
    r = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(1500):
        kind = r.choice(["shop", "item", "blog", "deep", "tag"])
        word = "".join(r.choice(list("abcdefgh"), 6))
        url = {"shop": f"http://A.com/casino/{i}/win.html", "item": f"http://a.com/item/{i}.html", "blog": f"http://a.com/blog/{word}/{i % 40}/",
               "deep": f"http://a.com/x/y/z/{word}", "tag": f"http://a.com/tag{i % 3}/{i}?q=1"}[kind]
        rows.append((i, url))
        labels.append(None if r.random() < 0.8 else int(kind in ("shop", "tag")))
    df = spark.createDataFrame([(*x, y) for x, y in zip(rows, labels)], "page_id long, url string, l int")
    got = [tuple(x) for x in U.judged(df, [], label=F.col("l")).select(COLS).collect()]
    assert order(got) == order(judged_by_hand(rows, [], labels))
    verdict = {x[0]: x[4] for x in got}
    assert all(verdict[i] == ("block" if "casino" in u or "/tag" in u else "allow") for i, u in rows)
    assert {x[5] for x in got} >= {"/{casino,tag0,tag1,tag2}/*/win.html", "/item/*.html", "/{casino,tag0,tag1,tag2}/*"}, {x[5] for x in got}


def test_urls_of_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "http://x", "HTTP://EXAMPLE.net", "http://example.net/en/", "http://sub.Example.NET/en/x?a/b",
            "http://notexample.net/en/", "ftp://net/", "http://org/fr/", "http://a.org/fr", "http://a.org/fr/#x", "x://y://z/://", "http://É.net/ü",
            "http://a.com//a//", "http://example.com/de/1\n2", "http://a.com/*/{x},%2A/*", "://net/"] + ["http://l.com/" + "s/" * 30_000] * 12
    rows = [(i if i % 4 else None, u) for i, u in enumerate(urls)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns(
        {c: F.lit(1) for c in ("host", "path", "rule", "n", "node", "rest", "label", "told", "total", "segment")})
    got = [tuple(x) for x in U.judged(df, U.RULES).select(COLS).collect()]
    assert order(got) == order(judged_by_hand(rows, U.RULES))
    by = {u: r for (_, u), r in zip(rows, judged_by_hand(rows, U.RULES))}
    assert by["http://sub.Example.NET/en/x?a/b"][3:5] == ("example.net/en/", "allow") and by["HTTP://EXAMPLE.net"][3] is None
    assert by["http://notexample.net/en/"][3] == "net/" and by["ftp://net/"][4] == "block" and by["http://a.org/fr"][3] is None
    assert U.judged(df.limit(0), U.RULES).count() == 0


def test_filters_run_without_python(spark):
    plan = U.op13_url_filters(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
