"""Link graph, conversation repair and Orchard's search, against brute force and on odd input."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from faultline.llm import linkgraph, orchard, repair
from faultline.llm.queries import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"

# ---- 11 ---------------------------------------------------------------------------------------------------------


def page(*hosts):
    return "<html><body>" + "".join(f'<p><a class="x" HREF = "https://{h}/a?b">x</a>' for h in hosts) + "<!-- <a href='//hidden.net/'> --><script>'<a href=\"http://script.net/\">'</script><a href='/own'>own</a></body></html>"


GRAPH = [
    ("http://Good.ORG/a", page("friend.net", "friend.net", "other.net")),
    ("http://good.org/b#x", page("friend.net")),
    ("https://friend.net/x?y=1", page("next.net")),
    ("https://spammer.net/1", page("evil.com", "evil.com")),
    ("https://spammer.net/2", page("evil.com", "next.net")),
    ("http://evil.com/de/9", page("spammer.net")),
    ("http://evil.com/en/9", None),
    ("http://next.net", ""),
    ("http://lonely.net/", "<a href='http://"),
    (None, page("spammer.net")),
    ("no host at all", page("good.org")),
    ("http://x.example.org/en/17", "<a href=//nopage.com/>"),
    ("http://x.example.org/es/", page("good.org") * 3),
    ("http://x.example.org/es/", page("good.org") * 3),
    ("ftp://example.org?q=/es/", page()),
    ("http://badexample.org/es/1", page()),
]


def by_hand(pages, rules, damping, rounds):
    """The verdicts by plain loops over pages, links and walks."""
    parsed = []
    for url, html in pages:
        rest = (url or "").split("://", 1)
        host = re.match(r"[^/?#]*", rest[1])[0] if len(rest) == 2 else ""
        path = re.match(r"[^?#]*", rest[1][len(host):])[0] if len(rest) == 2 else ""
        markup = re.sub(r"(?is)<!--.*?-->|<script.*?</script>", "", html or "")
        links = {h.lower() for h in re.findall(r"""(?i)href\s*=\s*["']?(?:[a-z]+:)?//([^/?#"'<>\s]+)""", markup)}
        parsed.append((host.lower(), path, links))

    def rule(host, path):
        fits = [(len(h + p), v == "block", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    hosts = {h for h, _, _ in parsed if h} | {t for h, _, links in parsed if h for t in links}
    n = {}
    for h, _, links in parsed:
        for t in links - {h}:
            if h:
                n[h, t] = n.get((h, t), 0) + 1
    crawled = {h for h, _, _ in parsed}
    counted = [(h, p) for h, p, _ in parsed if h] + [(h, "/") for h in hosts - crawled if any(t == h for _, t in n)]
    out = {}
    for verdict, flow in (("allow", n), ("block", {(t, s): c for (s, t), c in n.items()})):
        sent = {h: (1 - damping) * sum(rule(*x)[0] == verdict for x in counted if x[0] == h) for h in hosts}
        total = dict(sent)
        for _ in range(rounds):
            got = dict.fromkeys(hosts, 0.0)
            for (s, t), c in flow.items():
                got[t] += damping * sent[s] * c / sum(m for (x, _), m in flow.items() if x == s)
            sent = got
            total = {h: total[h] + sent[h] for h in hosts}
        out[verdict] = total
    rows = []
    for host, path, _ in parsed:
        said, name = rule(host, path)
        good, bad = out["allow"].get(host, 0.0), out["block"].get(host, 0.0)
        rows.append((host, path, name, said or ("block" if bad > good + 1e-9 else "allow"), round(good, 9), round(bad, 9)))
    return sorted(rows, key=repr)


def test_verdicts_follow_links(spark):
    rows = [(i, u, h, "kept", 7) for i, (u, h) in enumerate(GRAPH)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `a.b` string, verdict int").repartition(3)
    for rules in (linkgraph.RULES, linkgraph.RULES + (("block", "org", "/"), ("allow", "net", "/x")), ()):
        if not rules:
            judged = linkgraph.judge(pages, spark.createDataFrame([], "verdict string, host string, path string"))
        else:
            judged = linkgraph.judge(pages, rules)
        got = judged.collect()
        assert judged.columns == ["page_id", "url", "html", "a.b", "host", "path", "rule", "verdict", "trust", "distrust"]
        assert {r["a.b"] for r in got} == {"kept"}
        assert sorted(((r.host, r.path, r.rule, r.verdict, round(r.trust, 9), round(r.distrust, 9)) for r in got), key=repr) == by_hand(GRAPH, rules, linkgraph.DAMPING, linkgraph.ROUNDS)
    verdicts = {r.url: r.verdict for r in linkgraph.judge(pages).collect()}
    assert verdicts["https://spammer.net/1"] == "block" and verdicts["https://friend.net/x?y=1"] == "allow"
    assert verdicts["http://evil.com/en/9"] == "block" and verdicts[None] == "allow" and verdicts["http://x.example.org/en/17"] == "block"


def test_verdicts_salted_equal_sent(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(GRAPH)], "page_id long, url string, html string")
    sent = sorted(map(tuple, linkgraph.judge(pages).drop("html", "url").collect()), key=repr)
    monkeypatch.setattr(linkgraph, "MOST_SENT", 2)
    assert sorted(map(tuple, linkgraph.judge(pages).drop("html", "url").collect()), key=repr) == sent
    assert linkgraph.judge(pages.limit(0)).collect() == []


def test_broken_markup_is_linear(spark):
    broken = ("<a href=" * 50_000) + ("<!-- <script " * 50_000)
    got = spark.createDataFrame([(broken,), ("<a\nhref='http://ONE.net'><a data-href='http://two.net'><a href=three>",)], "html string")
    assert [r.l for r in got.select(linkgraph.linked_hosts(got.html).alias("l")).collect()] == [[], ["one.net"]]


def test_verdict_sql_on_a_fixture(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(GRAPH)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(CHECKS["op11_host_graph"]).fetchall()
    assert sorted(want) == sorted(map(tuple, QUERIES["op11_host_graph"](spark, str(tmp_path)).collect()))


# ---- 12 ---------------------------------------------------------------------------------------------------------

CODES = "xsua?SUA!"


def every_edit(codes, most=2):
    """(audit, cost) of all edits with at most `most` insertions in a place that end in order."""
    for row_edits in itertools.product("DKua", repeat=len(codes)):
        if any(e != "D" and c == "x" for e, c in zip(row_edits, codes)):
            continue
        for inserted in itertools.product([s for n in range(most + 1) for s in map("".join, itertools.product("ua", repeat=n))], repeat=len(codes) + 1):
            roles, audit, cost = "", "", 0
            for e, c, before in zip(row_edits, codes, inserted):
                roles, audit, cost = roles + before, audit + "I" * len(before), cost + 5 * len(before)
                late = 5 if c in "SUA!" and e != "D" else 0
                audit += {"D": "D", "K": "K"}.get(e, "R")
                cost += {"D": 2, "K": 0}.get(e, 1) + late
                roles += "" if e == "D" else c.lower() if e == "K" else e
            roles, audit, cost = roles + inserted[-1], audit + "I" * len(inserted[-1]), cost + 5 * len(inserted[-1])
            if re.fullmatch("(s?(ua)+)?", roles):
                yield cost, audit


def best_edit(codes):
    """The same by a plain table over prefixes, for longer conversations."""
    at = {"start": (0, "")}
    moves = {"start": {"u": "u", "s": "s"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserts(at):
        for _ in range(3):
            for q, (cost, audit) in list(at.items()):
                for r in "ua":
                    to = moves[q].get(r)
                    if to and (cost + 5, audit + "I") < at.get(to, (1 << 60, "")):
                        at[to] = (cost + 5, audit + "I")
        return at

    for c in codes:
        at, nxt = inserts(at), {}
        for q, (cost, audit) in at.items():
            options = [("D", 2, q)]
            if c != "x":
                late = 5 if c in "SUA!" else 0
                options += [("K", late, moves[q].get(c.lower()))] + [("R", late + 1, moves[q].get(r)) for r in "ua"]
            for letter, more, to in options:
                if to and (cost + more, audit + letter) < nxt.get(to, (1 << 60, "")):
                    nxt[to] = (cost + more, audit + letter)
        at = nxt
    return min(inserts(at)[q] for q in ("start", "a") if q in at)


def searched(codes, size):
    """By segments of `size`, as the Spark side does."""
    parts = [codes[i : i + size] for i in range(0, len(codes), size)]
    segments = []
    for p in parts:
        t = repair.between_states(p)
        ranked = {k: r for r, k in enumerate(sorted(t, key=lambda k: t[k][1]))}
        pairs = [(a, b) for a in range(4) for b in range(4)]
        segments.append(([t[k][0] if k in t else -1 for k in pairs], [ranked.get(k, -1) for k in pairs]))
    cost, pairs, tail = repair.chosen(segments)
    return cost, "".join(repair.between_states(p)[k][1] for p, k in zip(parts, pairs)) + tail


def test_search_equals_all_edits():
    for n in (1, 2):
        for codes in map("".join, itertools.product(CODES, repeat=n)):
            assert searched(codes, 8) == min(every_edit(codes)) == best_edit(codes), codes
    rnd = random.Random(1)
    for _ in range(25):
        codes = "".join(rnd.choice(CODES) for _ in range(3))
        assert searched(codes, 8) == min(every_edit(codes, 1)) == best_edit(codes), codes


def test_search_of_long_conversations():
    rnd = random.Random(2)
    for _ in range(400):
        kinds = rnd.choice(["ua", "uaua?xS", "s", "su", "xx?", CODES])
        codes = "".join(rnd.choice(kinds) for _ in range(rnd.randint(1, 60)))
        assert searched(codes, 1000) == searched(codes, rnd.randint(1, 9)) == best_edit(codes), codes
    for codes in ("s" * 3000, "u" * 3000, "x" * 3000, "ua" * 1500, "Us?x" * 800):
        assert searched(codes, repair.SEGMENT) == best_edit(codes)


def mended(rows):
    """The contract by plain Python over one conversation's rows (turn, role, text)."""
    key = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda a: (a[0] is not None, a[0] or 0, a[1], key(a[1], a[2])))
    seen, codes, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare, initial = text.rstrip(" \t\n\x0b\f\r"), role[:1] if role[:1] in tuple("sua") else "?"
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        codes += "x" if fault in ("blank", "duplicate") else initial if not fault else "!" if initial == "?" else initial.upper()
    cost, audit = best_edit(codes) if rows else (0, "")
    lines, i, last = [], 0, ""
    for letter in audit:
        turn_of = "assistant" if last == "u" else "user"
        if letter == "I":
            lines.append((turn_of, ""))
        elif letter == "R":
            lines.append((turn_of, rows[i][2]))
        elif letter == "K":
            lines.append(rows[i][1:])
        i += letter != "I"
        last = lines[-1][0][0] if lines else ""
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest())


def odd_conversations():
    rnd = random.Random(3)
    text = lambda: rnd.choice(["Hello there.", "What?", "No end", "Yes!  \n", " ", "", None, "a: b.", "Ünï.", "x" * rnd.randint(1, 3000) + "."])
    rows = [(c, rnd.choice([t, t, t, None, t + 3]), rnd.choice(["user", "assistant", "assistant", "system", None, "", "User", "tool"]), text()) for c in range(60) for t in range(rnd.randint(1, 12))]
    rows += [(None, 0, "user", "No id."), (None, 1, "assistant", "None."), (None, None, "system", "First.")]
    rows += [(900, t % 7, ["user", "assistant"][t % 2], f"Turn {t % 90}.") for t in range(300)]  # one long, with repeats
    rows += [(901, 5, "user", "Same.")] * 50 + [(902, 2**62, "user", "Far."), (902, -(2**62) - 9, "assistant", "Off.")]
    return rows


@pytest.mark.parametrize("segment", [4, repair.SEGMENT])
def test_repair_equals_plain_python(spark, segment):
    rows = odd_conversations()
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, n int").repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(table, segment).collect()}
    ids = {r[0] for r in rows}
    assert set(got) == ids
    for c in ids:
        want = mended([r[1:] for r in rows if r[0] == c])
        assert got[c] == ((None, *want[1:]) if want[0] >= 2**63 else want), c
    assert repair.repair(table.limit(0)).collect() == []


def test_damaged_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hurt = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        hurt[c] += [] if kind == 0 else [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in QUERIES["op12_repair"](spark, SF).collect()}
    assert got == {c: mended(r) for c, r in hurt.items()}
    assert any(g[5] for g in got.values())


# ---- 13 ---------------------------------------------------------------------------------------------------------


def lloyd(rows, k, rounds):
    """By plain Python over (id, components): every centroid measured for every vector."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    ordered = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in ordered[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in found), key=repr)


def odd_vectors(width=64):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(i % 5, 0.4) for _ in range(width)]) for i in range(120)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (200, [0.0] * width), (201, [-0.001] * width), (202, [rnd.gauss(0, 3000) for _ in range(width)])]
    bad = [(300, None), (301, []), (302, [1.0] * (width - 1)), (303, [float("nan")] * width), (304, [None] + [1.0] * (width - 1)), (305, [float("-inf")] + [1.0] * (width - 1)), (306, [1.0] * (width + 1))]
    return rows, bad


@pytest.mark.parametrize("k,rounds", [(40, 5), (3, 2), (500, 1), (1, 1)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rows, bad = odd_vectors()
    table = spark.createDataFrame([(i, v, 3, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, cluster int, v string").repartition(4)
    got = orchard.cluster(table, k, rounds)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == lloyd(rows, k, rounds)
    assert orchard.cluster(table.where("vec_id >= 300")).collect() == []


def test_clusters_of_wide_numbers(spark):
    rows = [(i, [float(i * 10**e), float(-(i % 7) * 10**e)]) for e in (3, 6) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [tuple(min(x, (1 << 63) - 1) if isinstance(x, int) else x for x in r) for r in lloyd(rows, 6, 3)]
    assert sorted((tuple(r)[:6] for r in orchard.cluster(table, 6, 3, dimensions=2).collect()), key=repr) == want


def test_search_skips_far_centroids_and_keeps_ties():
    rnd = np.random.default_rng(0)
    centres = rnd.integers(-300, 300, (40, 64))
    points = np.concatenate([centres[rnd.integers(0, 40, 4000)] + rnd.integers(-3, 4, (4000, 64)), centres, (centres[:1] + centres[1:2]) // 2]).astype(np.int64)
    found, distance, measured = orchard.Orchard([*centres.tolist(), *centres.tolist()]).search(points)
    exact = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (found == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert measured < len(points) * 80 / 4
