"""Tag distances, conflicts, forests, running sums and concept mentions against plain versions of the rules."""

import random
import re
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from quillstore.operators import conflicts as cf
from quillstore.operators import distance as ds
from quillstore.operators import forest as fo
from quillstore.operators import mining as mi
from quillstore.operators.orders import numbered, sums_before


def plain_distance(tags, source):
    """{n: hops} by breadth-first search from atom to tag to atom."""
    seen, queue = {source: 0}, deque([source])
    while queue:
        a = queue.popleft()
        for n, ts in tags.items():
            if n not in seen and set(ts or ()) & set(tags[a] or ()):
                seen[n] = seen[a] + 1
                queue.append(n)
    return {n: d for n, d in seen.items() if d <= 4}


@pytest.fixture(scope="module")
def tagged():
    r = random.Random(2)
    tags = {i: [f"t{i}", f"t{i + 1}"] for i in range(12)}  # a path of atoms
    tags |= {20 + i: [f"u{r.randrange(9)}", f"u{r.randrange(9)}"] for i in range(15)}
    tags |= {40 + i: ["hub", f"h{i % 7}"] for i in range(300)}  # all share one tag
    tags |= {400: [], 401: None, 402: ["alone"], 403: ["t0", "t1"], 404: ["u1", None, "u1"]}
    return tags


def test_tag_distance(spark, tagged):
    nodes = spark.createDataFrame(list(tagged.items()), "n long, tags array<string>")
    sources = [0, 5, 20, 40, 41, 400, 401, 402, 403, 404]
    got = ds.distance_counts(nodes, spark.createDataFrame([(s,) for s in sources], "n long")).collect()
    want = {}
    for s in sources:
        near = plain_distance({n: [t for t in ts or () if t] for n, ts in tagged.items()}, s)
        want |= {(s, d): c for d, c in Counter(near.get(n, 5) for n in tagged).items()}
    assert {(r.source, r.distance): r.atoms for r in got} == want
    pairs = [(a, b) for a in sources for b in (0, 1, 4, 5, 11, 26, 40, 339, 400, 401, 402, 403)]
    got = ds.pair_distances(nodes, spark.createDataFrame(pairs, "a long, b long")).collect()
    plain = {n: [t for t in ts or () if t] for n, ts in tagged.items()}
    assert {(r.a, r.b): r.distance for r in got} == {(a, b): plain_distance(plain, a).get(b, 5) for a, b in pairs}


def test_a_hub_spreads_once(spark):
    """Atoms with equal tags are one row of the search, and a source's state holds each tag and set once."""
    nodes = spark.createDataFrame([(i, ["hub", f"g{i % 5}"]) for i in range(20_000)], "n long, tags array<string>")
    keys = nodes.select(ds.tag_key("tags").alias("key"))
    assert ds.set_hops(keys, keys).count() == 25
    got = ds.distance_counts(nodes, nodes.where("n % 5000 = 0")).collect()
    assert {(r.source, r.distance, r.atoms) for r in got} == {(s, d, c) for s in (0, 5000, 10_000, 15_000) for d, c in ((0, 1), (1, 19_999))}


def overlaps(p, q):
    return p == q or p.startswith(f"{q}/") or q.startswith(f"{p}/")


def clash(x, y):
    loose = not x[2] or not y[2] or any(overlaps(p, q) for p in x[2] for q in y[2])
    return x[0] != y[0] and x[1] == y[1] and abs(x[3] - y[3]) > 0.3 + 1e-9 and loose


def test_conflicts_without_pairs(spark):
    r = random.Random(4)
    paths = ["a", "a/b", "a/b/c", "ab", "a/bc", "d", "d/e", "f"]
    rows = [(i, r.choice("xy"), r.sample(paths, r.choice([0, 1, 1, 2, 3])), r.randrange(0, 101) / 100) for i in range(150)]
    rows += [(200 + i, "x", ["a"], 0.1) for i in range(20)] + [(300 + i, "x", ["a", "d/e"], 0.9) for i in range(20)] + [(400, "z", [], 0.5), (401, "z", ["a", "a"], 0.8)]
    schema = "n long, type string, paths array<string>, confidence double"
    d = spark.createDataFrame(rows, schema)
    links = {x[0]: sum(clash(x, y) for y in rows) for x in rows}
    assert {x.n: x.links for x in cf.conflict_links(d).collect()} == links
    assert cf.n_conflicts(d).first().n == sum(links.values()) // 2
    drafts, others = [x for x in rows if x[0] % 3 == 0], [x for x in rows if x[0] % 3]
    got = {x.n for x in cf.blocked(spark.createDataFrame(drafts, schema), spark.createDataFrame(others, schema)).collect()}
    assert got == {x[0] for x in drafts if any(clash(x, y) for y in others)}
    none = spark.createDataFrame([], schema)
    assert cf.n_conflicts(none).first().n == 0 and cf.blocked(d, none).count() == 0


def test_a_hot_type_has_no_pairs(spark):
    """A million rows of one type: 10**11 pairs are counted in seconds."""
    d = spark.range(1_000_000).select(F.col("id").alias("n"), F.lit("t").alias("type"), F.array(F.lit("src")).alias("paths"), (F.col("id") % 2 * 0.5 + 0.2).alias("confidence"))
    assert cf.n_conflicts(d).first().n == 500_000**2


def plain_arcs(nodes, parent):
    """{n: (root, depth, position)} of trees of two or more."""
    out, kids = {}, {}
    for c, p in parent.items():
        if c in nodes and p in nodes:
            kids.setdefault(p, []).append(c)
    for root in nodes:
        if parent.get(root) in nodes:
            continue
        order, stack = [], [(root, 0)]
        while stack:
            n, d = stack.pop()
            order.append((n, d))
            stack += [(c, d + 1) for c in sorted(kids.get(n, []), key=lambda c: (nodes[c], c), reverse=True)]
        if len(order) > 1:
            out |= {n: (root, d, i) for i, (n, d) in enumerate(order)}
    return out


def test_arcs(spark):
    r = random.Random(6)
    nodes = {i: r.randrange(50) for i in range(200)}
    parent = {i: r.randrange(0, i) for i in range(1, 120) if i % 11}  # a random forest
    parent |= {120: 122, 121: 120, 122: 121, 123: 122, 124: 123, 125: 125, 126: 999, 127: 126}  # a cycle, what hangs below it, itself, a stranger
    parent |= {i: i - 1 for i in range(131, 190)}  # a chain of sixty
    d = spark.createDataFrame(list(nodes.items()), "n long, created_at int").repartition(3)
    e = spark.createDataFrame(list(parent.items()), "child long, parent long")
    got = {x.n: (x.root, x.depth, x.position) for x in fo.arcs(d, e, ["created_at", "n"]).collect()}
    want = plain_arcs(nodes, parent)
    assert {n: v for n, v in got.items() if v[0] is not None} == want
    assert {n for n, v in got.items() if v == (None, None, None)} == set(nodes) - set(want)
    assert fo.arcs(d.where("n < 0"), e, ["created_at", "n"]).count() == 0


def test_a_parent_of_many(spark):
    """Children of one parent are ordered over several partitions."""
    d = spark.range(3000).select(F.col("id").alias("n"), (F.col("id") * 7919 % 3001).alias("created_at"))
    e = d.where("n > 0").select(F.col("n").alias("child"), F.lit(0).cast("long").alias("parent"))
    got = fo.arcs(d, e, ["created_at", "n"]).where("n > 0").collect()
    order = sorted(range(1, 3000), key=lambda i: i * 7919 % 3001)
    assert {x.n: x.position for x in got} == {n: i + 1 for i, n in enumerate(order)}


def test_running_sums(spark):
    r = random.Random(8)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"g{r.randrange(5)}", i, r.randrange(10)) for i in range(2000)]
    d = spark.createDataFrame(rows, "g string, i long, v long").repartition(4)
    got = {x.i: x.before for x in sums_before(d, ["g"], ["i"], F.col("v"), "before").collect()}
    total, want = Counter(), {}
    for g, i, v in rows:
        want[i] = total[g]
        total[g] += v
    assert got == want
    assert {x.i: x.rank for x in numbered(d, [F.col("v").desc(), "i"]).collect()} == {i: k + 1 for k, (_, i, _) in enumerate(sorted(rows, key=lambda x: (-x[2], x[1])))}


def test_concept_mentions(spark):
    """Names of two, six and twelve words, in any case and with any joints, as the rule's own pattern finds them."""
    ids = {
        1: "FACT-2024-01-02-QUIET-RIVER-01", 2: "FACT-2024-01-02-ONE-TWO-THREE-FOUR-FIVE-SIX-02", 3: "FACT-2024-01-02-A1-B2-C3-D4-E5-F6-G7-H8-I9-J10-K11-L12-03",
        4: "FACT-2024-01-02-QUIET-RIVER-04", 5: "FACT-2024-01-02-DOUBLE-SHORT-DOUBLE-05", 6: "FACT-2024-01-02-SOLO-06", 7: "short", 8: "FACT-2024-01-02-ECHO-ECHO-08",
    }
    bodies = [
        "Quiet river, quiet-river; QUIET_RIVER and quiet  river, unquiet river, quiet rivers, _quiet river, quiet river_", "one two three four five six. One-two_three four-five",
        "x a1-b2 c3_d4 e5 f6 g7 h8 i9 j10 k11 l12 y; a1 b2 c3 d4 e5", "double short double short double", "double-short-double double short double", "solo", "", None,
        "echo echo echo echo echo", "the quiet river's étquiet river", "quiet\nriver quiet\triver (quiet river)", "echo-echo_echo xecho echo",
    ]
    rows = [(i + 1, ids.get(i + 1, f"FACT-2024-01-02-OTHER-THING-{i + 1:02d}"), b) for i, b in enumerate(bodies)]
    names = {}
    for n, a, _ in rows:
        parts = a.split("-")
        slug = [p.lower() for p in parts[4:-1]] if len(parts) >= 6 else []
        if len(slug) >= 2 and len("-".join(slug)) >= 8:
            names.setdefault("-".join(slug), set()).add(n)
        if len(slug) > 5 and len("-".join(slug[:5])) >= 10:
            names.setdefault("-".join(slug[:5]), set()).add(n)
    mentions, cited = {}, {}
    for n, _, b in rows:
        for name, holders in names.items():
            count = len(re.findall(rf"\b{name.replace('-', '[-_ ]')}\b", b or "", re.I | re.A))
            if count and holders - {n}:
                mentions[n, name] = (count, len(holders - {n}))
            for t in holders - {n} if count else ():
                c = cited.setdefault(t, [0, set()])
                c[0] += count
                c[1].add(n)
    d = spark.createDataFrame(rows, "n long, atom_id string, body string")
    assert {(x.n, x.concept): (x["count"], x.targets) for x in mi.concept_references(d).collect()} == mentions
    assert {x.target: (x.citations, x.sources) for x in mi.concept_citations(d).collect()} == {t: (c, len(s)) for t, (c, s) in cited.items()}
    assert mi.concept_references(d.where("n = 7")).count() == 0


def test_stems():
    """Words and stems that the algorithm's paper gives, by step."""
    from quillstore.functions.stemming import stem

    pairs = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
      sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
      hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
      decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
      electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
      replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
      bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil running run runs run run run""".split()
    assert {w: stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))
    assert stem("is") == "is" and stem("as") == "as" and stem("") == "" and stem("s" * 70) == "s" * 70 and stem("straßen") and stem("日本語") == "日本語"


def test_stemmed_search(spark):
    from quillstore.functions.stemming import stem
    from quillstore.operators import ranking as rk

    r = random.Random(7)
    forms = ["run", "runs", "running", "connect", "connected", "connection", "connections", "relate", "related", "rational", "sky", "skies", "a", "été"]
    docs = [(i, [r.choice(forms) for _ in range(r.randrange(0, 20))]) for i in range(60)]
    d = spark.createDataFrame(docs, "n long, words array<string>")
    texts = {"q1": "running connections", "q2": "connects connecting", "q3": "skies été", "q4": "nothing"}
    got = {(x.query_id, x.n): x.b for x in rk.bm25_stemmed(d, rk.query_terms(spark, texts)).groupBy("query_id", "n").agg(F.round(F.sum("part"), 9).alias("b")).collect()}
    stems = spark.createDataFrame([(n, [stem(w) for w in ws]) for n, ws in docs], d.schema)
    asked = {q: " ".join(dict.fromkeys(stem(t) for t in text.split())) for q, text in texts.items()}
    want = {(x.query_id, x.n): x.b for x in rk.bm25(stems, rk.query_terms(spark, asked)).groupBy("query_id", "n").agg(F.round(F.sum("part"), 9).alias("b")).collect()}
    assert got == want and len(got) > 60


def plain_chunks(text):
    """[(line, heading, body)] by the rules, line by line."""
    lines = (text or "").split("\n")
    heads = [(i, m[1].strip()) for i, x in enumerate(lines) if (m := re.match(r"^#{2,3}\s+([^\r]+)$", x))]
    if heads:
        ends = [i for i, _ in heads[1:]] + [len(lines)]
        out = [(i, h, "\n".join(lines[i + 1 : e]).strip()) for (i, h), e in zip(heads, ends)]
    else:
        out, now = [], None
        for i, x in enumerate(lines):
            if m := re.match(r"^[-*]\s+(.*)", x):
                now = [i, m[1]] if m[1] else None
                out.append(now) if now else None
            elif now and re.match(r"^\s{2,}", x):
                now[1] += " " + x.strip()
            else:
                now = None
        out = [(i, None, b.strip()) for i, b in out if len(b.strip()) >= 20] or [(0, None, (text or "").strip())]
    return [x for x in out if len(x[2]) >= 20]


def test_markdown_chunks(spark):
    from quillstore.sources import markdown as md

    long = "a sentence that is long enough"
    files = {
        "heads": f"before\n## One \n{long}\n\n{long}\n### Two\nshort\n#### four\n## Three\n- {long}\n## Four", "heads only short": "## A\nb\n## C\n- d", "top": f"# Title\n{long}", "not a head": f"##x {long}\n##\n",
        "bullets": f"intro that is long enough to count\n- {long}\n  and its\n   rest\n* {long}\nout\n  not in\n-no bullet\n- short\n- \n  {long}\n-  {long}  ", "whole": f"\n\n  {long}\n{long} \n", "short": "too short",
        "empty": "", "null": None, "blank lines in a bullet": f"- {long}\n   \n  more\n\n  gone",
    }
    got = md.chunks(spark.createDataFrame(list(files.items()), "file string, text string").repartition(3)).collect()
    found = {f: sorted((x.start, x.heading, x.body) for x in got if x.file == f) for f in files}
    assert found == {f: plain_chunks(t) for f, t in files.items()}


def test_many_walks_are_as_one_each(spark):
    """Each walk has what spread() gives from its seeds alone."""
    from quillstore.operators import graph as gr

    r = random.Random(9)
    nodes = [(i, r.sample(["a", "b", "c", "d", "hub"], r.randrange(0, 4)), r.uniform(-2, 3)) for i in range(250)]
    edges = [(r.randrange(250), r.randrange(250), r.choice(["extends", "supports", "related"])) for _ in range(300)]
    n = spark.createDataFrame(nodes, "n long, tags array<string>, base double")
    e = spark.createDataFrame(edges, "src long, tgt long, rel string").where("src <> tgt")
    seeds = {1: [3], 2: [10, 20, 30], 3: [77, 9999], 4: [4, 4]}
    s = spark.createDataFrame([(w, x) for w, xs in seeds.items() for x in xs], "walk long, n long")
    got = {(x.walk, x.n): round(x.act, 7) for x in gr.walks(n, e, s).collect()}
    want = {}
    for w, xs in seeds.items():
        one = spark.createDataFrame([(x,) for x in sorted({x for x in xs if x < 250})], "n long")
        want |= {(w, x.n): round(x.act, 7) for x in gr.spread(n, e, one).collect()}
    assert got == want and len({w for w, _ in got}) == 4


def test_headers_read():
    from quillstore.sources.header import Bad, load, split

    text = """id: FACT-1   # a comment
# another
type: "fact: \\"quoted\\" \\u00e9\\n"
status: 'it''s'
confidence: 0.75
n: -3
ttl_days: ~
on_time: 2024-01-02T03:04:05Z
empty:
url: http://x.org/#frag
tags: [a, "b, c", 'd', [e, {f: 1}],
  g]
scope:
  tags:
    - hub
    - "- dash"
  paths: []
  deep: {a: {b: null}}
relations:
- target: FACT-2
  type: extends
-   target: "FACT: 3"
    type: supports
    more:
      - x
summary: |
  two
    lines

  and # no comment
folded: >-
  one
  two

  three
kept: |+
  x

last: end"""
    want = {
        "id": "FACT-1", "type": 'fact: "quoted" é\n', "status": "it's", "confidence": 0.75, "n": -3, "ttl_days": None, "on_time": "2024-01-02T03:04:05Z", "empty": None, "url": "http://x.org/#frag",
        "tags": ["a", "b, c", "d", ["e", {"f": 1}], "g"], "scope": {"tags": ["hub", "- dash"], "paths": [], "deep": {"a": {"b": None}}},
        "relations": [{"target": "FACT-2", "type": "extends"}, {"target": "FACT: 3", "type": "supports", "more": ["x"]}],
        "summary": "two\n  lines\n\nand # no comment\n", "folded": "one two\nthree", "kept": "x\n\n", "last": "end",
    }
    assert load(text) == want and load(text.replace("\n", "\r\n")) == want
    for bad in ("a: b: c", "- x\ny: 1", "a: [1, 2", 'a: "x', "a: 'x' y", "a:\n  b: 1\n c: 2", "just text", "a: 1\na: 2", "\ta: 1", "a: *x", "a: @x", 'a: "\\q"', "a: {b}", "a: |x\n  y"):
        with pytest.raises(Bad):
            load(bad)
        assert split(f"---\n{bad}\n---\nbody") == (None, f"---\n{bad}\n---\nbody")
    assert split("\ufeff---\na: 1\n---\nbody") == ('{"a": 1}', "body") and split("---\r\na: x\r\n---\r\nbody") == ('{"a": "x"}', "body")
    assert split("no fence") == (None, "no fence") and split("---\na: 1\nno end") == (None, "---\na: 1\nno end") and split(None) == (None, None) and split("") == (None, "")
    assert split("---\n---\nb") == ("{}", "b") and split("---\n- a\n---\nb")[0] is None


def test_hostile_headers_come_back():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from quillstore.sources.header import dump, load

    odd = "null yes ~ - # ' \" | > 1e5 0x1 [a] {b} a: --- @x ` % &a *b !t true 1 -1 .5 2024-01-01 no: ? :".split() + ["- a", "a: b", "x #y", " lead", "trail ", "a\nb", "a\tb", "\ufeffx", "\u2028", "\x85", "é #", "", "a\r\nb", "...", "\x7f"]
    texts = st.text(max_size=15) | st.sampled_from(odd)
    scalars = st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.floats(allow_nan=False, allow_infinity=False) | texts
    values = st.recursive(scalars, lambda c: st.lists(c, max_size=3) | st.dictionaries(texts, c, max_size=3), max_leaves=10)

    @settings(max_examples=500, deadline=None, derandomize=True)
    @given(st.dictionaries(texts, values, min_size=1, max_size=5))
    def back(d):
        assert load(dump(d)) == d

    back()


def test_headers_in_spark(spark):
    from quillstore.sources import header

    rows = [(1, '{"id": "X: 1", "tags": ["a b", "- c", "null"], "scope": {"paths": ["p#q"]}, "n": 2}', "body\n---\nmore"), (2, '{"id": "---"}', "")]
    d = spark.createDataFrame(rows, "n int, header string, body string")
    texts = d.select("n", header.rendered("header", "body").alias("text"))
    got = texts.select("n", header.parsed("text").alias("x")).select("n", F.from_json("x.header", "id string, tags array<string>, scope struct<paths: array<string>>, n int").alias("h"), "x.body").orderBy("n").collect()
    assert got[0].h.id == "X: 1" and got[0].h.tags == ["a b", "- c", "null"] and got[0].h.scope.paths == ["p#q"] and got[0].h.n == 2 and got[0].body == rows[0][2]
    assert got[1].h.id == "---" and got[1].body == ""


def test_compaction_leaves_a_log(spark):
    """The compacted log is its events, all that W3 keeps; what was dropped adds up."""
    from quillstore.plans import catalog
    from quillstore.sources import tables as tb

    sf = "/root/testdata/sf0.001"
    got = catalog.QUERIES["L8_compact_log"](spark, sf).collect()
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in catalog.QUERIES["W3_compaction"](spark, sf).collect())
    assert len(got) + sum(r.dropped for r in got) == tb.log(spark, sf).count()


def test_cadence_keeps_every_run(spark):
    """A row for each run: those of A9, and the first ones, which have no week before."""
    from quillstore.plans import catalog

    sf = "/root/testdata/sf0.001"
    got = catalog.QUERIES["H16_eval_cadence"](spark, sf).collect()
    old = [r for r in got if r.baseline_runs]
    assert {(r.cat, r.day, r.rate, r.prior, r.alert) for r in old} == {tuple(r) for r in catalog.QUERIES["A9_eval_cadence"](spark, sf).collect()}
    assert {r.cat for r in got if r.alert == "new"} == {r.cat for r in got} and any(r.latest for r in got)
