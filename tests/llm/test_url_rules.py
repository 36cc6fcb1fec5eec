import random
import re
from collections import Counter
from itertools import combinations
from math import ceil

from pyspark.sql import functions as F

from lodestone.llm import url_rules as ur

SCHEMA = "page_id long, url string, html string, host string, path string, verdict string, row long, tokens string, items string"


def parse(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in ur.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if host and fits else (None, None)


def tokens(url, host, path):
    own = {f"d{i + 1}={x}" for i, x in enumerate(y for y in host.split(".")[::-1] if y)}
    own |= {f"p{i + 1}={'#' + x[0] if re.match('[0-9]', x) else x}" for i, x in enumerate(y for y in path.split("/") if y)}
    if m := re.search(r"\.([A-Za-z0-9]{1,8})$", path):
        own.add(f"x={m[1]}")
    q = re.match(r"(?s)^[^?#]*\?([^#]*)", url or "")
    return own | {f"q={k}" for k in re.findall(r"(?:^|&)([^=&]+)", q[1] if q else "")}


def brute_rules(labelled):
    n, of, single = Counter(), Counter(), Counter(t for own, _ in labelled for t in own)
    for own, v in labelled:
        own = [t for t in own if single[t] >= ur.SUPPORT * len(labelled)]  # parts of a frequent combination are frequent
        for k in range(1, ur.LONGEST + 1):
            for c in combinations(sorted(own), k):
                n[c] += 1
                of[c, v] += 1
    strong = {(c, v): (m / n[c], m) for (c, v), m in of.items() if m >= ceil(ur.SUPPORT * len(labelled)) and m / n[c] >= ur.CONFIDENCE}
    return {(c, v): x for (c, v), x in strong.items() if not any(strong.get((p, v), (0,))[0] >= x[0] for k in range(1, len(c)) for p in combinations(c, k))}


def brute(urls):
    rows = [(u, *parse(u)) for u in urls]
    hits = [rule(h, p) for _, h, p in rows]
    mined = brute_rules([(tokens(u, h, p), v) for (u, h, p), (r, v) in zip(rows, hits) if r])
    out = []
    for (u, h, p), (r, v) in zip(rows, hits):
        own = tokens(u, h, p)
        best = min(((-x[0], -x[1], w != "block", " ".join(c), w) for (c, w), x in mined.items() if set(c) <= own), default=None)
        out.append((h, p, r, v or (best[4] if best else "allow"), None if r or not best else best[3]))
    return out


def key(r):
    return tuple(str(x) for x in r)


def urls_of(rng, n):
    host = lambda: rng.choice(["", "www.", "m.", "Blog."]) + rng.choice(["a", "b", "Casino-win"]) + ".example." + rng.choice(["com", "org", "net", "ORG"])
    path = lambda: rng.choice(["/en/", "/fr/", "/de/", "/es/", "/EN/"]) + str(rng.randint(1, 400)) + rng.choice(["", "/", ".html"])
    return [rng.choice(["http", "https"]) + "://" + host() + path() + rng.choice(["", "?page=2&ref=x", "#top", "?utm_source=f#/en/1"]) for _ in range(n)]


EDGES = [None, "", "no scheme", "://", "http://", "http://org", "http://org/", "http://org?x=/en", "http://com/fr", "http://com/fr/", "x://y://example.org/es/", "http://notexample.org/es/1", "http://EXAMPLE.org/es/",
         "http://example.org/ES/", "http://example.org#/es/", "http://a..b.example.org./x", "http://example.org/en/1?a&b=1&&=c", "\nhttp://example.org/es/\n?q=\n", "http://www.example.org/en/1/" + "long/" * 5000]


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    urls = urls_of(rng, 600) + EDGES + ["http://a.example.net/de/5"] * 40
    rows = [(i // 2, u, "h", "other", "p", "v", 3, "t", "i") for i, u in enumerate(urls)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = ur.op13_url_filter(spark, str(tmp_path)).collect()
    want = [(i // 2, *w) for i, w in enumerate(brute(urls))]
    assert sorted(key((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["mined"])) for r in got) == sorted(map(key, want))
    assert any(w[5] and w[4] == "block" for w in want) and any(w[5] and w[4] == "allow" for w in want)


def test_labels_of_ones_own(spark):
    urls = [f"https://{h}.example.com/{p}/{i}" for i, (h, p) in enumerate([("good", "a"), ("bad", "a"), ("good", "spam"), ("bad", "spam")] * 30)]
    labels = [(u, "block" if "bad" in u and "spam" in u else "allow") for u in urls]
    pages = spark.createDataFrame([(1, "https://bad.example.com/spam/x"), (2, "https://bad.example.com/a/x"), (3, "https://else.example.net/spam/7")], "page_id long, url string")
    found = ur.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), labels=spark.createDataFrame(labels, "url string, verdict string"))
    got = {r["id"]: (r["verdict"], r["mined"]) for r in found.collect()}
    assert got[1] == ("block", "d3=bad p1=spam") and got[2][0] == "allow" and got[3][0] == "allow"


def test_rules_are_indexed_by_their_rarest_token(spark):
    rows = [(["a", "b"], "block")] * 40 + [(["b", "c"], "allow")] * 60 + [(["a", "c"], "allow")] * 30
    found = ur.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    got = {tuple(r["items"]): r["key"] for r in found.collect()}
    assert got == {("a", "b"): "a", ("c",): "c"}


def test_empty_and_unlabelled(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/a/pages.parquet")
    assert ur.op13_url_filter(spark, f"{tmp_path}/a").collect() == []
    spark.createDataFrame([(None, None), (1, "http://x.net/")], "page_id long, url string").withColumn("rule", F.lit("r")).write.parquet(f"{tmp_path}/b/pages.parquet")
    assert sorted(map(key, ur.op13_url_filter(spark, f"{tmp_path}/b").collect())) == [("1", "x.net", "/", "None", "allow", "None"), ("None", "", "", "None", "allow", "None")]
