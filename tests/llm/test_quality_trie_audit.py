"""Factorisation machine, prefix trie and filter audit against plain versions."""

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations, permutations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from cladewise.llm import filter_audit, prefix_trie, quality, queries  # noqa: E402

DATA = Path("/root/testdata/sf0.01")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Quality ------------------------------------------------------------------------------------------------------------

def plain_facts(text):
    data, words = text.encode(), [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [line for line in text.split("\n") if line]
    counts = Counter(words)

    def share(a, b):
        return a / max(b, 1)

    def chars(wanted):
        return share(sum(chr(b) in wanted for b in data), len(data))
    return {
        "upper": chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": chars("0123456789"), "white": chars(" \t\n\x0b\x0c\r"),
        "symbol": chars("#$%&*+<=>@^_|~\\"), "wide": share(sum(b > 127 for b in data), len(data)),
        "words": np.log1p(len(words)) / 16, "distinct": share(len(counts), len(words)),
        "most": share(max(counts.values(), default=0), len(words)),
        "word_length": share(sum(len(w.encode()) for w in words), len(words)) / 32,
        "lines": np.log1p(len(lines)) / 16, "distinct_lines": share(len(set(lines)), len(lines)),
    }, counts


def test_inputs_equal_a_plain_reading():
    texts = [r[1] for r in cases.rows()] + ["A!! B!! A!!\nA!! B!! A!!\n", " lead", "a\n\nb\na", "$$ %% a_b", "12 é3"]
    x = quality.inputs(pa.array(texts, pa.string()), [[i] for i in range(len(texts))])
    assert len(x) == len(texts)
    for i, text in enumerate(texts):
        own = slice(x.bounds[i], x.bounds[i + 1])
        got = defaultdict(float)
        for at, value in zip(x.at[own].tolist(), x.value[own].tolist()):
            got[at] += value
        facts, counts = plain_facts(text or "")
        for name, value in facts.items():
            first = quality.BUCKETS + quality.STATISTICS.index(name) * quality.KNOTS
            spot = sum(k * got[first + k] for k in range(quality.KNOTS))
            assert spot == pytest.approx(np.sqrt(min(max(value, 0), 1)) * (quality.KNOTS - 1), abs=1e-4), (name, text[:40])
        words = [v for at, v in got.items() if at < quality.BUCKETS]
        assert len(words) <= len(counts) and sum(v * v for v in words) == pytest.approx(float(bool(counts)), abs=1e-4)
        if 0 < len(counts) < 30 and len(words) == len(counts):
            want = sorted(np.log1p(list(counts.values())))
            assert sorted(words) == pytest.approx(list(np.array(want) / np.linalg.norm(want)), abs=1e-4)
        assert got[quality.BUCKETS + quality.STRUCTURE + i % quality.META] == 1


def test_pair_sum_in_linear_time_equals_all_pairs():
    draw = np.random.default_rng(0)
    net = quality.Machine(draw.normal(size=quality.INPUTS), draw.normal(size=(quality.INPUTS, quality.RANK)), 0.3)
    x = quality.inputs(pa.array(["one two two three", "", "x"]))
    for i, odds in enumerate(net.log_odds(x)):
        own = list(zip(x.at[x.bounds[i]:x.bounds[i + 1]], x.value[x.bounds[i]:x.bounds[i + 1]].astype(float)))
        want = net.bias + sum(net.weight[a] * v for a, v in own)
        want += sum(float(net.factor[a] @ net.factor[b]) * u * v for (a, u), (b, v) in combinations(own, 2))
        assert odds == pytest.approx(want, abs=1e-6)


def graded(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        good = int(i % 5 != 0)
        text = cases.sentence(cases.EN if i % 2 else cases.DE, 50 + i % 7, i)
        if not good:
            text = text.upper() if i % 2 else text.replace(" ", " ** ")
        rows.append((i, text, len(text)))
        labels.append((i, good))
    extra = [(9_001, None, None), (9_002, "", 0), (None, "null doc", 3), (7, "other text of a repeated id", None)]
    docs = spark.createDataFrame(rows + extra + [rows[3]], "doc_id long, text string, n_chars long")
    return docs, spark.createDataFrame(labels + [(5, None), (None, 1), (6, 0), (10_000, 1)], "doc_id long, quality int"), rows


def test_low_quality_is_found_in_texts_not_learned_from(spark):
    docs, labels, rows = graded(spark)
    machine = quality.fit(docs, labels, ["n_chars"])
    found = quality.scored(docs, machine, ["n_chars"])
    assert found.columns == [*docs.columns, "_quality"]
    scores = [(r.doc_id, r.text, r._quality) for r in found.collect()]
    assert len(scores) == len(rows) + 5 and all(0 <= s <= 1 for *_, s in scores)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    texts = {i: text for i, text, _ in rows}
    wrong = [i for i, text, s in scores if i in held and text == texts[i] and (s >= 0.5) != (i % 5 != 0)]
    assert len(wrong) <= 0.03 * len(held)
    again = quality.fit(docs.repartition(5), labels, ["n_chars"])
    assert again.bias == machine.bias and (again.factor == machine.factor).all()


def test_the_share_of_classes_is_that_of_all_labels(spark):
    docs, labels, rows = graded(spark)
    few = quality.fit(docs, labels, per_class=20)
    scores = quality.scored(docs.where("doc_id < 9000"), few).selectExpr("avg(_quality) as m").first().m
    assert scores == pytest.approx(0.8, abs=0.08)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels, rows = graded(spark, 200)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    one, other = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert one.bias == other.bias and (one.weight == other.weight).all()


def test_nothing_or_one_class_to_learn_from(spark):
    docs, none = cases.documents(spark), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, none) == 0.5
    assert {r._quality for r in quality.scored(docs, 0.5).collect()} == {0.5}
    assert quality.fit(docs, spark.createDataFrame([(i, 1) for i in range(10, 30)], "doc_id long, quality int")) == 1.0
    machine = quality.Machine(np.zeros(quality.INPUTS), np.zeros((quality.INPUTS, quality.RANK)), 0.0)
    assert quality.scored(cases.no_documents(spark), machine).count() == 0
    assert quality.scored(docs, machine, ["lang", "n_chars"]).count() == len(cases.rows())


# Prefix trie --------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth int, path string"


def plain_paths(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    turns = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        origin = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = tuple(turns.get(origin, [])[:h] + turns[c][h:])
    return out


def plain_trie(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        gain = (len(own) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += gain
    out = set()
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if paths[c] == p)
        parent = min(members[p[:-1]]) if p else None
        out.add((min(own), len(p), parent, len(own), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def chats():
    rows = []
    for c in range(-25, 160):
        if c % 13 == 0:
            continue
        for t in range(c % 6 + 1):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"said {c % 3 if t < 2 else c} words  of\tturn {t}", 1, "x"))
    for c in range(200, 320):  # a hot conversation
        rows += [(c, t, "user", f"the same words {t}", 1, "x") for t in range(3)]
    rows += [(400, t, "user", f"long {t % 2}", 1, "x") for t in range(700)]
    rows += [(401, t, "user", f"long {t % 2}", 1, "x") for t in range(699)]
    rows += [(500, None, None, None, 1, "x"), (500, 3, "user", "b", 1, "x"), (500, 3, "user", "a", 1, "x"), (500, None, "system", "z", 1, "x")]
    rows += [rows[5], rows[5], (None, 1, "user", "nobody", 1, "x"), (3_000_000_000, 1, "user", "said 0 words  of\tturn 0", 1, "x")]
    rows += [(521, 0, "", "", 1, "x"), (522, 0, "user", "x" * 50_000 + " y", 1, "x")]
    return rows


@pytest.mark.parametrize("shards,turns", [(1, 256), (7, 256), (40, 256), (7, 2)])
def test_trie_equals_all_prefixes(spark, monkeypatch, shards, turns):
    monkeypatch.setattr(prefix_trie, "SPLITTER_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "BLOCK", 40)
    rows = chats()
    paths = plain_paths(rows)
    convs = prefix_trie.rebuilt(prefix_trie.conversations(spark.createDataFrame(rows, TURNS).repartition(5)))
    found = [tuple(r) for r in prefix_trie.trie(convs, shards).collect()]
    want = plain_trie(paths)
    assert len(found) == len(want) and set(found) == want
    assert any(not p for p in paths.values())  # a rebuilt conversation without turns


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(none)))
    assert found.count() == 0 and found.columns[0] == "conv_id"
    one = prefix_trie.conversations(spark.createDataFrame([(c, 1, "user", "x", 1, "") for c in (1, 2)], TURNS))
    empty = one.selectExpr("conv_id", "slice(turns, 1, 0) as turns")
    ends = hashlib.sha256(b"1,2").hexdigest()
    assert [tuple(r) for r in prefix_trie.trie(empty).collect()] == [(1, 0, None, 2, 0, 1, 0, ends)]


def test_a_shard_holds_open_nodes_only():
    keys = [bytes([i]) * 16 for i in range(4)]
    skeleton = prefix_trie.Skeleton.of([(keys[1] + keys[2], 5)])
    assert [skeleton.shard(p, c) for p, c in ((keys[1] + keys[2], 4), (keys[1] + keys[2], 5), (keys[0], 9))] == [0, 1, 0]
    out = []
    shard = prefix_trie.Shard(1, skeleton, out)
    for conv_id in range(5, 2_000):
        shard.add(keys[1] + keys[2] + keys[3], conv_id, [1, 1, 1])
    assert len(shard.stack) == 4 and not out
    shard.finish()
    assert [r[0] for r in out] == [prefix_trie.LOCAL, *[prefix_trie.PARTIAL] * 3]


# Filter audit -------------------------------------------------------------------------------------------------------

def audited(rows, labels):
    """The contract, order by order and document by document."""
    marks = defaultdict(lambda: (False, False))
    for doc, good, toxic in labels:
        if doc is not None:
            marks[doc] = (marks[doc][0] or good == 1, marks[doc][1] or toxic == 1)
    first = {}
    for doc, text, *_ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    docs = defaultdict(list)
    for doc, text, _, source, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if doc is not None and first[text] < doc:
            fails.add("E")
        docs[source or ""].append((fails, *(marks[doc] if doc is not None else (False, False))))
    out = set()
    for part, own in docs.items():
        found, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[0]]
                left = [d for d in left if name not in d[0]]
                failing = sum(name in d[0] for d in own)
                alone = sum(d[0] == {name} for d in own)
                shapley[name] += len(gone)
                found.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), alone,
                              sum(d[1] for d in gone), sum(d[2] for d in gone), name))
        out |= {(*row[:-1], shapley[row[-1]]) for row in found}
    return out


def audit_rows():
    rows = []
    for i, r in enumerate(cases.rows()):
        text = r[1]
        if text and i % 4 == 0:
            text = text.upper()
        if text and i % 5 == 0:
            text += " $5 | tab"
        rows.append((r[0], text, r[2], ["a", "b", None, ""][i % 4], *r[4:]))
    long = cases.sentence(cases.EN, 230, 3)
    rows += [(1000 + i, long, None, f"s{i % 3}", None, "", "", "", "") for i in range(90)]  # a hot text in three parts
    rows += [(1000, long, None, "s1", None, "", "", "", ""), (None, long, None, "s0", None, "", "", "", "")]
    rows += [(5, "other # text", None, "a", None, "", "", "", ""), (5, "other # text", None, "b", None, "", "", "", "")]
    rows += [(2000 + i, " ".join(f"w{i}x{j}" for j in range(250)), None, "a", None, "", "", "", "") for i in range(3)]
    return rows


def test_audit_equals_every_order(spark):
    rows = audit_rows()
    labels = [(r[0], i % 2, int(i % 3 == 0)) for i, r in enumerate(rows)] + [(1001, None, None), (10**6, 1, 1), (5, 1, 0)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    found = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got, want = [tuple(r) for r in found.collect()], audited(rows, labels)
    assert len(got) == len(want) and set(got) == want


def test_audit_of_nothing_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(cases.no_documents(spark), none).count() == 0
    found = filter_audit.audit(cases.documents(spark), none)
    assert found.count() == 600 and found.selectExpr("sum(good_lost + toxic_lost) as n").first().n == 0


def test_carry_save_counts_equal_plain_ones():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 50, 1000):
        words = draw.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.int64)
        times = draw.integers(0, 1 << 20, n) * draw.integers(0, 2, n)
        want = [int(sum(t for w, t in zip(words.tolist(), times.tolist()) if w >> s & 1)) for s in range(32)]
        assert filter_audit.positional_counts(words, times).tolist() == want


# The registered queries ---------------------------------------------------------------------------------------------

@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_registered_queries_give_their_contract(spark):
    rows = queries.BUILDERS["op11_quality"](spark, str(DATA)).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)

    turns = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.BUILDERS["op12_prefix_trie"](spark, str(DATA)).collect()
    assert {tuple(r) for r in found} == plain_trie(plain_paths(turns))

    found = queries.BUILDERS["op13_filter_audit"](spark, str(DATA)).collect()
    own = [(d.doc_id, d.text, d.lang, d.source) for d in docs.values()]
    marks = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    assert {tuple(r) for r in found} == audited(own, marks)
