"""Bills of materials and safe URLs against plain Python."""

import hashlib
import ipaddress
import random
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from claimloom.functions import urls
from claimloom.operators import bills, context


def test_stable_ids_equal_a_plain_digest(spark):
    rnd = random.Random(5)
    keys = [None, 1, 2, 3, 4]
    items = [(rnd.choice(keys), rnd.choice([None, "é", "b", "c"]) if i % 9 == 0 else f"c{i:04d}", rnd.choice(["", None, "text", "ü\n" * 40]), "x") for i in range(700)]
    items += [(4, "c9999", "z" * 300_000, "x")] * 2
    items = [i for i in items if i[0] != 3]
    finals = [(1, "final"), (1, "fina"), (3, "only a final text"), (2, None)]
    rows = spark.createDataFrame(items, "run long, context_id string, text string, _key string").repartition(5)
    got = {r["run"]: r["bill_id"] for r in bills.stable_ids(rows, spark.createDataFrame(finals, "run long, text string"), "run").collect()}
    want = {}
    for k in keys:
        h = hashlib.sha256()
        mine = [i for i in items if i[0] == k]
        for _, name, text, _ in sorted(mine, key=lambda i: (i[1] is not None, i[1] or "", i[2] or "")):
            h.update((name or "").encode() + b"\0" + (text or "").encode() + b"\0")
        h.update(max([f[1] or "" for f in finals if f[0] == k], default="").encode())
        want[k] = h.hexdigest()[:16]
    assert got == want
    empty = spark.createDataFrame([], "run long, context_id string, text string")
    assert bills.stable_ids(empty, empty.select("run", "text"), "run").count() == 0


def test_what_is_wrong_with_references(spark):
    inputs = spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "c", None), (1, "b", False), (2, "a", True), (None, "a", True)], "k int, context_id string, admitted boolean")
    made = spark.createDataFrame([(1, "t1", ["a", "b"]), (1, "t2", ["x", "a", "y"]), (2, "t3", []), (2, "t4", None)], "k int, transform_id string, input_ids array<string>")
    claims = spark.createDataFrame(
        [(1, "c1", ["a"]), (1, "c2", ["c", "a", "b"]), (1, "c3", ["b", "zz"]), (1, "c3", ["b", "zz"]), (2, "c4", ["b"]), (None, "c5", ["a"]), (2, None, [None])], "k int, claim_id string, support_ids array<string>"
    )
    over = spark.createDataFrame([(1, "o1", "a"), (1, "o2", "q"), (1, "", "b"), (2, None, "a"), (None, "o3", "a")], "k int, override_id string, context_id string")
    got = {(r["k"], r["stage"], r["error"]) for r in bills.problems(inputs, made, claims, over, "k").collect()}
    assert got == {
        (1, 0, "transformation t2 references unknown context input(s): x, y"),
        (1, 1, "claim c2 references blocked support input(s): c, b"),
        (1, 1, "claim c3 references unknown support input(s): zz"),
        (2, 1, "claim c4 references unknown support input(s): b"),
        (2, 1, "claim  references unknown support input(s): null"),
        (1, 2, "classification override o2 references unknown context_id: q"),
        (1, 2, "classification override for context_id b has empty override_id"),
        (2, 2, "classification override for context_id a has empty override_id"),
    }
    found = spark.createDataFrame([(1,), (1,)], "k int")
    bill = {r["k"]: r for r in bills.built(inputs, made, claims, found, over, found, "k").collect()}
    one = bill[1].asDict()
    assert one == {
        "k": 1, "context_inputs": 4, "admitted_material": 1, "blocked_material": 3, "transformations": 2, "claims": 4, "review_findings": 2, "classification_overrides": 3,
        "override_ledger_refs": 2, "errors": 5, "error": "transformation t2 references unknown context input(s): x, y",
    }
    assert bill[None]["errors"] == 0 and bill[None]["error"] is None and bill[None]["claims"] == 1


def test_heads_and_requirements(spark):
    items = [(1, "a", "The official report cites data.", None), (1, "b", "Private reasoning about the plan.", None), (None, "c", "Use a shorter style and tone.", None), (2, "d", None, "Fresh Critic")]
    rows = context.classify(spark.createDataFrame(items, "run long, context_id string, text string, source_agent string"))
    finals = spark.createDataFrame([(1, "x"), (3, "y")], "run long, text string")
    heads = {r["run"]: r for r in bills.headers(rows, finals, spark.createDataFrame([(1,), (1,), (None,)], "run long"), "run").collect()}
    assert {k: (r["total_context_items"], r["violations"], r["verdict"]) for k, r in heads.items()} == {1: (2, 2, "blocked"), 2: (1, 0, "pass"), 3: (0, 0, "pass"), None: (1, 1, "blocked")}
    ids = {r["run"]: r["bill_id"] for r in bills.stable_ids(rows, finals, "run").collect()}
    assert {k: r["bill_id"] for k, r in heads.items()} == ids
    free = {r["context_id"] for r in rows.where("can_influence_output").collect()}
    said = bills.transforms(rows, "run")
    assert {r["context_id"] for r in said.collect()} == free and said.columns == ["run", "context_id", "kind", "text"]
    assert bills.headers(rows.limit(0), finals.limit(0), finals.select("run").limit(0), "run").count() == 0


def addresses():
    """All edges of the blocks and their neighbours, in several spellings."""
    found = set()
    for blocks, top in ((urls.IPV4_BLOCKS + urls.IPV4_GLOBAL, 2**32), (urls.IPV6_BLOCKS + urls.IPV6_GLOBAL, 2**128)):
        make = ipaddress.IPv4Address if top == 2**32 else ipaddress.IPv6Address
        for net in map(ipaddress.ip_network, blocks):
            for n in (int(net.network_address), int(net.broadcast_address)):
                found |= {make(x) for x in (n - 1, n, n + 1) if 0 <= x < top}
    rnd = random.Random(3)
    found |= {ipaddress.IPv4Address(rnd.getrandbits(32)) for _ in range(200)} | {ipaddress.IPv6Address(rnd.getrandbits(128) >> rnd.choice([0, 64, 112])) for _ in range(200)}
    mapped = {ipaddress.IPv6Address(f"::ffff:{a}") for a in found if a.version == 4}
    return sorted(found | mapped, key=lambda a: (a.version, int(a)))


def test_globals_equal_ipaddress_on_all_edges(spark):
    spelled = {}
    for a in addresses():
        wanted = (a.ipv4_mapped if a.version == 6 and a.ipv4_mapped else a).is_global
        for text in {str(a), a.exploded, str(a).upper()}:
            spelled[text] = wanted
        if a.version == 6 and a.ipv4_mapped:
            spelled[f"::ffff:{a.ipv4_mapped}"] = wanted
    rows = spark.createDataFrame(list(spelled), "string").toDF("a")
    got = {r["a"]: r["g"] for r in rows.select("a", urls.is_global(F.col("a")).alias("g")).collect()}
    assert got == spelled


def test_what_is_no_address(spark):
    texts = ["", "example.org", "1.2.3.4.5", "1.2.3.256", "256.1.1.1", "1.2.3.", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::12345", "g::", "::1.2.3", "09.1.1.1", "4294967296", "1:2:3:4:5:6:7::8", "::1.2.3.400", "0x", "1..2", None]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select(urls.is_global(F.col("a")).alias("g")).collect()
    assert [r["g"] for r in rows] == [None] * len(texts)
    loop = ["127.1", "0x7f.1", "2130706433", "0177.0.0.1", "127.0.1", "fe80::1%eth0", "0", "017700000001"]
    rows = spark.createDataFrame(loop, "string").select(urls.is_global(F.col("value")).alias("g")).collect()
    assert [r["g"] for r in rows] == [False] * len(loop)
    assert spark.createDataFrame(["8.8.8.8", "134744072", "8.8.2056", "0x8.8.8.8"], "string").where(~urls.is_global(F.col("value"))).count() == 0


def test_urls_and_their_hosts(spark):
    texts = [
        "http://example.org/a", "HTTPS://User:pw@Example.ORG:80/x?y#z", "ftp://8.8.8.8", "http://8.8.8.8", "http://[::1]/", "https://[2606:4700::1111]:443/a", "http:///a", "http://", "javascript:alert(1)", "  http://10.0.0.1",
        "http://a@b@127.0.0.1/", "http://8.8.8.8:80", "ht\ttp://8.8.8.8", "http://8.8.8.8?x=//10.0.0.1", "file:///etc/passwd", "example.org", "", "http://good.example", "http://mixed.example", "http://odd.example/", "http://:80",
    ]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "url string")
    hosts = {r["url"]: r["h"] for r in rows.select("url", urls.url_host(F.col("url")).alias("h")).collect()}
    for t in texts:
        parts = urlsplit(t)
        assert hosts[t] == (parts.hostname or None if parts.scheme else None), t
    known = spark.createDataFrame([("Good.example", "8.8.8.8"), ("good.example", "2606:4700::1111"), ("mixed.example", "8.8.8.8"), ("mixed.example", "10.1.1.1"), ("odd.example", "what")], "host string, address string")
    got = {r["url"] for r in urls.safe_urls(rows, known).where("safe").collect()}
    assert got == {"http://8.8.8.8", "https://[2606:4700::1111]:443/a", "http://8.8.8.8:80", "ht\ttp://8.8.8.8", "http://8.8.8.8?x=//10.0.0.1", "http://good.example"}
    assert urls.safe_urls(rows, known).count() == len(texts) + 1
