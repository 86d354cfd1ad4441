"""The ten operators and the pipeline against brute force, on small tables with nulls, ties, copies and odd columns."""

import collections
import dataclasses
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docframe.llm import bpe, chat, components, decontaminate, importance, langid, minhash, pii, queries, rules, substrings, toxicity
from docframe.llm.vocab import vocabulary
from tests.conftest import SMALL, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, extra=""):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long" + extra)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    got = rows_of(df.columns, df.collect())
    cursor = duck.execute(queries.ORACLE_SQL[name])
    assert got == rows_of([c[0] for c in cursor.description], cursor.fetchall())


# 1 chat


def test_chat_round_trip():
    rnd = random.Random(1)
    bits = [*chat.CONTROL, "\\", "a", "\n", "[", "INST]", "<", "x", "y", "é", "</", "s>"]
    for _ in range(500):
        turns = [(rnd.choice(["user", "assistant", "", "we[/ROLE]\nird"]), "".join(rnd.choice(bits) for _ in range(rnd.randrange(8)))) for _ in range(rnd.randrange(6))]
        out, spans, rewrites = chat.render(turns)
        assert not rewrites
        assert [chat.unescape(out[x:y]) for _, _, x, y in spans] == [t for _, t in turns]


def test_chat_rewritten_history():
    def forgets(turns):
        return "".join(f"<{r}>{t if k == len(turns) - 1 else t[:2]}</>" for k, (r, t) in enumerate(turns))

    _, spans, rewrites = chat.render([("u", "hello"), ("a", "there"), ("u", "ok")], forgets)
    assert rewrites == [1, 2] and spans[:2] == [None, None] and spans[2] is not None


def segments_of(n):
    return dataclasses.replace(chat.DEFAULT, segment=n)


def test_chat_segments_and_nulls(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", None if t == 3 else f"t{t}</s>") for t in range(9)] + [(None, 0, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, parts = (sorted(map(tuple, chat.digests(turns, segments_of(n)).collect()), key=str) for n in (None, 2))
    assert whole == parts == sorted(map(tuple, chat.digests(turns).collect()), key=str)
    one = chat.formatted(turns.where("conv_id = 1"), segments_of(2)).first()
    assert [chat.unescape(one["formatted"][s["text_start"] : s["text_end"]]) for s in one["spans"]] == [r[3] or "" for r in rows[:9]]
    assert chat.digests(turns.limit(0)).count() == 0


def test_chat_long_conversation_with_a_rewriting_template(spark):
    """A template that keeps the last 550 turns only: every turn after them rewrites, wherever it is."""
    turns = spark.createDataFrame([(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(600)], "conv_id long, turn long, role string, text string")
    keeps = chat.Template(lambda turns: "".join(f"<{r}>{t}</>" for r, t in turns[-550:]))
    found = chat.digests(turns, keeps).first()
    assert found["n_rewrites"] == 50
    one = chat.formatted(turns, keeps).first()
    assert one["rewrites"] == list(range(550, 600))
    plain = chat.digests(turns).first()
    assert (plain["n_turns"], plain["n_rewrites"], plain["loss_chars"]) == (600, 0, sum(len(f"t{t}") for t in range(1, 600, 2)))


def test_chat_false_declaration_is_seen(spark):
    """A template that marks the first turn only, declared to look at no other turn."""
    turns = spark.createDataFrame([(1, t, "user", f"t{t}") for t in range(7)], "conv_id long, turn long, role string, text string")
    first = chat.Template(lambda turns: "".join(f"{'<s>' if k == 0 else ''}{t}|" for k, (_, t) in enumerate(turns)), segment=3)
    assert chat.digests(turns, first).first()["n_rewrites"] == 2
    assert chat.digests(turns, dataclasses.replace(first, segment=None)).first()["n_rewrites"] == 0


def test_chat_ties_repeats_and_clashing_columns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "n"), (1, 1, "assistant", "x" * 300_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n_turns", "2 AS spans")
    found = chat.digests(turns).first()
    order = [("assistant", "n"), ("user", "a"), ("user", "a"), ("user", "b"), ("assistant", "x" * 300_000)]
    assert found["n_turns"] == 5 and found["loss_chars"] == 300_001
    assert found["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()


# 2 substrings


def removed_by_force(texts, n):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                m[i : i + n] = True
        spans = int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum())
        out.append((len(b), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest()))
    return out


@pytest.mark.parametrize("most", [8192, 3])
def test_substrings(spark, most):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abé \n") for _ in range(n))
    shared = [text(300) for _ in range(3)]
    texts = [None, "", text(50), "x" * 700, "ab" * 400] + [text(rnd.randrange(100)) + rnd.choice(shared)[rnd.randrange(60) : rnd.randrange(200, 300)] + text(rnd.randrange(200)) for _ in range(40)]
    texts += [*texts[8:12], texts[6] + "z", texts[7][:-3]]
    got = {r[0]: tuple(r[1:]) for r in substrings.deduplicated(docs_of(spark, texts), 200, most).collect()}
    assert [got[k] for k in range(len(texts))] == removed_by_force(texts, 200)


def test_substrings_long_and_empty(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PART", 1000)
    rnd = random.Random(2)
    long = "".join(rnd.choice("abc") for _ in range(5000))
    data, at = np.frombuffer(long.encode(), np.uint8), np.array([0, 5000])
    starts = set()
    for _, offset, part, ends in substrings._parts(data, at, 200):
        _, _, first, last, _, _ = substrings._anchors(part, ends, 200)
        for a, b in zip(first, last):
            own = set(range(int(a + offset[0]), int(b + offset[0]) + 1))
            assert not own & starts
            starts |= own
    assert starts == set(range(4801))
    assert substrings.deduplicated(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_substrings_odd_rows_and_very_long_texts(spark):
    """Null and repeated doc_ids, clashing columns, and a text of several parts that shares a passage with itself and another."""
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage = text(300)
    long = text(4_300_000) + passage + text(700_000) + passage + text(100)
    rows = [(1, long), (1, text(50) + passage), (None, text(400)), (2, text(400)), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS n_bytes", "3 AS part")
    got = sorted((r[0] or 0, r[1], r[2], r[3]) for r in substrings.deduplicated(docs).collect())
    assert got == sorted([(1, len(long), 600, 2), (1, 350, 300, 1), (0, 400, 0, 0), (2, 400, 0, 0), (2, 0, 0, 0)])


# 3 near duplicates


def sets_of(texts, size):
    out = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def components_by_force(sets, percent):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(k) for k in range(len(sets))]


@pytest.mark.parametrize("block", [4096, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "NODES", block)
    rnd = random.Random(3)
    word = lambda: rnd.choice(["The", "of", "x", "y", "zz", "á"]) + str(rnd.randrange(60))
    texts = [None, "", "  \n", "One", "one", "a b", "A B"]
    for _ in range(8):
        base = [word() for _ in range(rnd.randrange(20, 90))]
        texts.append(" ".join(base))
        for _ in range(9):
            copy = list(base)
            for _ in range(rnd.randrange(5)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, 3, 85).collect()}
    sets = sets_of(texts, 3)
    expected = components_by_force(sets, 85)
    assert [got[k]["component_id"] for k in range(len(texts))] == expected
    assert [got[k]["n_shingles"] for k in range(len(texts))] == [len(s) for s in sets]
    assert [got[k]["kept"] for k in range(len(texts))] == [k == c for k, c in enumerate(expected)]
    kept = minhash.stage(docs.unionByName(docs.where("doc_id = 8")), 3, 85)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected))


def test_near_duplicates_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (2, "a b c d"), (1, "a b c d"), (1, "other words of it")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(rows, 3, 85).collect()), key=str)
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]
    assert minhash.near_duplicates(rows.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(None, 1), (5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    least = {x: x for e in edges for x in e if x is not None}
    for _ in range(400):
        for a, b in edges:
            if a is not None:
                least[a] = least[b] = min(least[a], least[b])
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: least[x] for x in linked}


# 4 decontamination

ITEM = "If Bob has 12 apples and gives 5 kg of apples to Mary how many apples does Bob have after 3 days"


def test_decontamination(spark):
    other = ITEM.replace("Bob", "Zoe").replace("12", "99").replace("5 kg", "7 miles").replace("Mary", "Ann")
    broken = "Then If Tom has 12 apples and gives 99 kg of apples to Sue how many apples does Kim have after 77 days"
    texts = [ITEM, None, "", "A text about something else that is long enough for many windows of words", f"Before. {other}. After that.", "if " * 400, ITEM.upper().replace("AFTER", "BEFORE")[:40], broken]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (10, "12 34 56 78 90 12 34 56 78")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) >= {(0, 7), (4, 7)} and {k for _, k in got} == {7}
    assert {d for d, _ in got} <= {0, 4, 7}
    assert got[0, 7]["n_changed"] == 0 and got[4, 7]["n_changed"] >= 3
    left = decontaminate.stage(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(8)) - {d for d, _ in got}
    assert decontaminate.matches(docs.limit(0), bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_decontamination_judges_each_occurrence(spark):
    """A copy beside variants of it, variants beside each other, a repeated frame, rows that share a doc_id."""
    other = ITEM.replace("Bob", "Zoe").replace("12", "99").replace("5 kg", "7 miles").replace("Mary", "Ann")
    third = ITEM.replace("Bob", "Kim").replace("12", "31").replace("5 kg", "8 tons").replace("Mary", "Sue").replace("3 days", "9 weeks")
    frame = "On Monday the shop in Paris sold 12 boxes of green apples for 4 dollars, on Tuesday the shop in London sold 30 boxes of green apples for 7 dollars"
    longer = frame.replace("Paris", "New York").replace("12", "17")
    docs = spark.createDataFrame([(0, f"{ITEM}. {other}."), (1, f"{other}. Well, {third}. {ITEM}."), (2, f"Well. {frame}."), (3, f"{other}. {third}."), (4, ITEM), (4, f"So it is that we say: {other}."), (5, longer)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM), (8, frame)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == {(0, 7), (1, 7), (2, 8), (3, 7), (4, 7), (5, 8)}
    assert got[0, 7] == got[2, 8] == 0 and got[3, 7] >= 3


def test_decontamination_of_items_without_templates(spark):
    """Slot-heavy, short and unspaced items are found as they are, and slot-heavy ones not by their template."""
    sums, table, short = "Compute 12 + 7 * 3 - 9 / 4 + 15", "3 kg 5 kg 8 kg 13 kg 21 kg 34 kg", "Name the capital"
    words, thai = "小明有12个苹果，给了小红5个，还剩几个？", "นักเรียนมีแอปเปิลสิบสองผล"
    mixed = "Which of these numbers is a prime and why is it so 12 15 18 21 24 27 30 33 36 39 42"
    bench = spark.createDataFrame([(1, sums), (2, table), (3, short), (4, words), (5, thai), (6, mixed), (7, "?!")], "item_id long, text string")
    changed = words.replace("12", "31").replace("5", "8")
    texts = [f"So: {sums}.", "Compute 13 + 8 * 4 - 1 / 2 + 16", f"we have {table} here", table.replace("3", "7"), f"well, {short.lower()} of it", f"题目：{words}答案", changed, f"ก {thai}", mixed[-40:], mixed.replace("1", "7"), "?! 中文 other text"]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs_of(spark, texts), bench).collect()}
    assert got == {(0, 1), (2, 2), (4, 3), (5, 4), (6, 4), (7, 5), (8, 6), (9, 6)}


def test_decontamination_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    docs, bench = docs_of(spark, [ITEM, "no"]), spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.matches(docs, bench).collect()] == [0]


def test_decontamination_against_words(spark):
    """On the test tables: documents that hold eight words of an item in a row, punctuation aside."""
    cut = re.compile(r"[^\W_]+")
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    windows = collections.defaultdict(set)
    for r in bench.collect():
        w = cut.findall(r["text"].lower())
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].add((r["item_id"], k))
    expected = set()
    for r in docs.collect():
        w = cut.findall(r["text"].lower())
        met = collections.defaultdict(set)
        for k in range(len(w) - 7):
            for item, p in windows.get(tuple(w[k : k + 8]), ()):
                met[item].add(p)
        expected |= {(r["doc_id"], i) for i, p in met.items() if len(p) >= 3}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()} == expected


def test_decontamination_odd_rows(spark):
    """Repeated items and documents, null ids, clashing columns, a copy with one name changed in one place."""
    half = "Once " + ITEM.replace("Bob", "Kim", 1).replace("12", "44")
    docs = spark.createDataFrame([(0, ITEM), (0, ITEM), (None, ITEM), (1, half), (2, "A clean text of words that no item has at all")], "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS item_id", "3 AS p")
    bench = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, ITEM), (None, "x")], "item_id long, text string").selectExpr("*", "4 AS h", "5 AS doc_id")
    got = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in decontaminate.matches(docs, bench).collect()}
    assert {k for k in got if k[0] == 0} == {(0, 7), (0, 8)} and got[0, 7] == 0
    assert (1, 7) in got and got[1, 7] <= 1  # the windows that are as they were suffice
    left = decontaminate.stage(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} >= {None, 2} and left.where("doc_id = 0").count() == 0


# 5 personal data


def base_by_force(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_base():
    rnd = random.Random(3)
    for _ in range(20_000):
        s = "".join(rnd.choice("a@.-+ 1290(%)4") for _ in range(rnd.randrange(40)))
        assert pii.base_spans(s) == base_by_force(s), s


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write to john [at] mail (dot) example (dot) org now", "email", "john [at] mail (dot) example (dot) org"),
        ("john.doe at example dot com", "email", "john.doe at example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
        ("at one nine two dot one six eight dot zero dot one end", "ip", "one nine two dot one six eight dot zero dot one"),
        ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
        ("card 4lll 1111 llll 1111", "card", "4lll 1111 llll 1111"),
        ("we look at this point in time, one two three four", None, None),
        ("at this point we had one or two", None, None),
        ("x" * 70 + " at example dot com", "email", "x" * 70 + " at example dot com"),
        ("john at example dot zone", "email", "john at example dot zone"),
        ("a dot b dot c dot d dot e dot f at mail dot x dot example dot org", "email", "a dot b dot c dot d dot e dot f at mail dot x dot example dot org"),
        ("john  at\nexample\t dot \n com", "email", "john  at\nexample\t dot \n com"),
        ("john [  at  ] example (\ndot\n) com", "email", "john [  at  ] example (\ndot\n) com"),
        ("four    one one one, one   one one one ( one ) one one one - one one      one one", "card", "four    one one one, one   one one one ( one ) one one one - one one      one one"),
        ("jean arroba exemple point fr", "email", "jean arroba exemple point fr"),
    ],
)
def test_pii_disguised(text, kind, span):
    base, every = pii.all_spans(text)
    assert set(base) <= set(every)
    assert [(k, text[a:b]) for k, a, b in every if (k, a, b) not in base] == ([(kind, span)] if kind else [])


@pytest.mark.parametrize(
    "address",
    [
        "jane [at] example dot com", "jane at example [dot] com", "jane at example.com", "jane@example dot com", "jane at example dot cz", "jane dot doe at example dot com",
        "jane [dot] doe at mail dot example (dot) museum", "jane.doe@mail dot example.org", "jane dot doe@example.com",
    ],
)
def test_pii_mixed_disguises(address):
    text = f"Write to {address}, or call."
    assert pii.masked(text, pii.all_spans(text)[1]) == "Write to <EMAIL>, or call."


def test_pii_disguise_ends_at_a_known_label():
    text = "jane at example dot com dot there"
    assert [text[a:b] for _, a, b in pii.all_spans(text)[1]] == ["jane at example dot com"]


def test_pii_long_texts_take_linear_time():
    import time

    for piece in ("a dot ", "a at ", "1 ", "one ", "1 l ", " ", "[ ", "a.", "at\n", "@", "a@", "+1 ", "plus ", "(", "о"):
        text = piece * (400_000 // len(piece))
        began = time.perf_counter()
        pii.all_spans(text + "a")
        assert time.perf_counter() - began < 20, piece


DISGUISES = {
    "email": [lambda a: a.replace("@", " at ").replace(".", " dot "), lambda a: a.replace("@", " [at] ").replace(".", "(dot)"), lambda a: a.replace("e", "е"), lambda a: a.replace("@", "@\u200b"), lambda a: a.replace("@", " AT ")],
    "ip": [lambda a: a.replace(".", " dot "), lambda a: a.replace(".", "[.]"), lambda a: "".join(chr(0xFF10 + int(c)) if c.isdigit() else c for c in a), lambda a: a.replace("1", "l") if "1" in a[1:] and len(a) > 12 else a.replace(".", "(dot)")],
    "card": [lambda a: a.replace("0", "O"), lambda a: " ".join("zero one two three four five six seven eight nine".split()[int(c)] for c in a), lambda a: "".join(chr(0xFF10 + int(c)) for c in a)],
    "phone": [lambda a: a.replace("+", "plus "), lambda a: "plus " + " ".join("zero one two three four five six seven eight nine".split()[int(c)] for c in a if c.isdigit()), lambda a: a.replace("1", "１")],
}


def test_pii_recall_on_planted_disguises():
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("bcdfghklmnprstvw") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 4)))

    def card():
        d = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    make = {
        "email": lambda: f"{word()}.{word()}@{word()}.{rnd.choice(['com', 'org', 'zone', 'fr'])}",
        "ip": lambda: ".".join(str(rnd.randrange(100, 256)) for _ in range(4)),
        "card": card,
        "phone": lambda: "+1" + "".join(rnd.choice("0123456789") for _ in range(9)),
    }
    for kind, ways in DISGUISES.items():
        for way in ways:
            found = 0
            for _ in range(60):
                hidden = way(make[kind]())
                text = f"Some {word()} here, {hidden}, and {word()} {word()}."
                start = text.index(hidden)
                found += any(k == kind and a <= start and b >= start + len(hidden) for k, a, b in pii.all_spans(text)[1])
            assert found >= 54, (kind, hidden, found)


def test_pii_rows(spark):
    docs = docs_of(spark, [None, "", "a@b.c and 1.2.3.4", "a@b.c and 1.2.3.4", "clean"], "").withColumn("spans", F.lit("own"))
    rows = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    assert rows[0]["spans"] == "" and rows[2]["spans"] == "email:0:5,ip:10:17" and rows[2]["n_ip"] == 1
    assert rows[2]["base_sha256"] == hashlib.sha256(b"email:0:5,ip:10:17").hexdigest()
    out = {r["doc_id"]: r for r in pii.stage(docs).collect()}
    assert out[2]["text"] == "<EMAIL> and <IP>" and out[2]["n_chars"] == len(out[2]["text"]) and out[4]["text"] == "clean" and out[0]["text"] is None


def test_pii_empty_table_and_very_long_text(spark):
    docs = docs_of(spark, ["word " * 200_000 + "a@b.org " + "z " * 100_000, None]).selectExpr("*", "1 AS n_email", "2 AS base_sha256")
    rows = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    assert rows[0]["spans"] == "email:1000000:1000007" and rows[1]["spans"] == ""
    assert pii.spans(docs.limit(0)).count() == 0 and pii.stage(docs.limit(0)).columns == docs.columns


# 6 toxicity


def toxic_rows(n=900):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 7)))
    rows, marks = [], []
    for k in range(n):
        w = [word() for _ in range(60)]
        if k % 3 == 0:
            for _ in range(4):
                w[rnd.randrange(60)] = rnd.choice(["hateful", "villain", "rubbish"])
        rows.append((k, " ".join(w)))
        marks.append((k, int(k % 3 == 0)))
    return rows, marks


def test_toxicity(spark):
    rows, marks = toxic_rows()
    odd = [(1000, None), (1001, ""), (1002, rows[0][1]), (1002, rows[0][1]), (None, rows[0][1]), (1003, rows[0][1] + " word" * 200_000)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "7 AS toxic", "'x' AS score")
    labels = spark.createDataFrame([*marks, *marks[:5], (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    out = {r["doc_id"]: r for r in got}
    truth, held = dict(marks), {r["doc_id"] for r in docs.where(toxicity.held_out()).collect()}
    right = [out[k]["score"] for k in held if truth.get(k) == 1], [out[k]["score"] for k in held if truth.get(k) == 0]
    assert np.mean([a > b for a in right[0] for b in right[1]]) > 0.95
    assert 0 <= out[1000]["score"] == out[1001]["score"] <= 1
    assert out[0]["score"] == out[1002]["score"] == out[None]["score"]
    assert None not in held
    # The score by plain steps.
    one, two = toxicity.compressors(model["pair"])
    for k, text in [*rows[:60], (1000, "")]:
        w = [x.strip(toxicity._STRIP) for x in text.lower().split()]
        saved = []
        for at in range(0, len(w), toxicity.WINDOW):
            window = model["lead"] + (" " + " ".join(w[at : at + toxicity.WINDOW]) + " ").encode() + toxicity._TAIL
            saved.append(len(two.compress(window)) - len(one.compress(window)))
        n, steps = len(saved), range(1, toxicity.STEPS + 1)
        above, below = ([sum(x >= s for x in saved) for s in steps], [sum(x <= -s for x in saved) for s in reversed(steps)])
        x = [*np.log1p(above), *np.sqrt(np.array(above) / max(1, n)), *np.log1p(below), *np.sqrt(np.array(below) / max(1, n)), np.log1p(n)]
        z = float(np.dot((np.array(x) - model["mean"]) / model["scale"], model["weights"][:-1]) + model["weights"][-1])
        assert abs(out[k]["score"] - 1 / (1 + np.exp(-z))) < 1e-9 and out[k]["predicted"] == (out[k]["score"] >= 0.7)
    assert toxicity.scored(docs, toxicity.fit(docs, labels.limit(0))).where("score <> 0").count() == 0
    assert toxicity.scored(docs.limit(0), model).count() == 0
    assert toxicity.scored(docs, toxicity.fit(docs.limit(0), labels)).count() == len(got)


def test_toxicity_dictionaries_come_from_their_text():
    rows, marks = toxic_rows()
    toxic, ordinary = ([t for (_, t), (_, m) in zip(rows, marks) if m == k] for k in (1, 0))
    one, two = toxicity.train_dictionaries(toxic, ordinary)
    assert one.endswith(two) and len(two) == toxicity.ORDINARY and two.startswith(b"7\xa40\xec")  # the trainer's mark
    own = one[: -len(two)]
    for w in (b"hateful", b"villain", b"rubbish"):
        assert w in own and w not in two
    # The trained content is cut out of the class's samples (segments of 8 and of 20 bytes meet without a seam).
    ones, zeros = [toxicity._samples(t) for t in toxic], [toxicity._samples(t) for t in ordinary]
    for content, source, least in ((own[-100:], b"".join(toxicity.characteristic(ones, zeros)), 0.6), (two[-4000:], b"".join(w for t in zeros for w in t), 0.25)):
        parts = [content[k : k + 6] for k in range(len(content) - 5)]
        assert np.mean([p in source for p in parts]) > least


# 7 rules


def test_rules(spark):
    rnd = random.Random(7)
    texts = [None, "", " \n ", "a b c " * 30, "line one\n" * 40 + "end", "é" * 10 + " ##" + " *$%&|<>"]
    texts += ["\n".join(" ".join(rnd.choice(["a", "b", "cé", "#d"]) for _ in range(rnd.randrange(5))) for _ in range(rnd.randrange(30))) for _ in range(60)]
    texts.append(" ".join(f"w{k}" for k in range(80)))
    got = {r["doc_id"]: r for r in rules.judged(docs_of(spark, texts)).collect()}
    for k, t in enumerate(t or "" for t in texts):
        w = WORD.findall(t)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines, again = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in lines
                lines.add(line)
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(cover))
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert got[k]["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        limits = all(chars_by_force(w, n) <= limit * max(1, sum(map(len, w))) for n, limit in rules.LIMITS.items())
        if got[k]["kept"]:
            assert limits and not got[k]["base_failed"]
    assert got[len(texts) - 1]["kept"]


def chars_by_force(w, n):
    seen, cover = set(), set()
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            cover |= set(range(i, i + n))
        seen.add(g)
    return sum(len(w[j]) for j in cover)


def test_rules_coverage():
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcé") for _ in range(rnd.randrange(120))) for _ in range(30)]
    m = rules.measures(pa.array(texts))
    for n in rules.LIMITS:
        assert list(m[f"chars_{n}"]) == [chars_by_force(t.split(), n) for t in texts]


def test_rules_empty_table_and_very_long_text(spark):
    docs = docs_of(spark, [" ".join(f"w{k}" for k in range(250_000)), "same " * 200_000]).selectExpr("*", "1 AS n_words", "2 AS kept")
    got = {r["doc_id"]: r for r in rules.judged(docs).collect()}
    assert got[0]["kept"] and got[0]["n_repeat_words"] == 0 and not got[1]["kept"] and got[1]["n_repeat_words"] == 200_000
    assert rules.judged(docs.limit(0)).count() == 0


# 8 importance


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(importance, "LEAST", 20)
    rnd = random.Random(9)
    values = [rnd.gauss(0, 1) for _ in range(1500)] + [0.25] * 300
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 17, 700, 1800):
        assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "x", 0) is None and importance.kth_largest(df, "x", 9999) is None


def test_importance(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    out = importance.resampled(docs, labels).cache()
    assert out.count() == docs.count()
    good = labels.agg(F.avg("quality")).first()[0]
    assert out.where("kept").count() == round(docs.count() * good)
    none = importance.resampled(docs, labels.limit(0))
    assert none.where("kept").count() == docs.count() and none.where("log_weight <> 0").count() == 0
    assert importance.resampled(docs.limit(0), labels).count() == 0


def grams_by_force(text):
    """Buckets of the words and word pairs of a text."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) & mask
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def word(b):
        power, total = 1, 0
        for c in b:
            total = (total + mix(c) * power) & mask
            power = power * 0xD6E8FEB86659FD95 & mask
        return mix((total + len(b) * 0x632BE59BD9B4E019) & mask)

    w = [word(x.encode()) for x in WORD.findall(text or "")]
    two = [(mix(a ^ 0x51ED270B9F0C2A35) + mix(b ^ (0x51ED270B9F0C2A35 * 2 & mask))) & mask for a, b in zip(w, w[1:])]
    return [x % importance.BUCKETS for x in w + two]


def test_importance_by_force(spark):
    """Weights, keys and the drawn documents by plain counting; nulls, ties, repeated rows, long texts, clashing columns."""
    rnd = random.Random(31)
    texts = [None, "", " \n", "one", "été one two"] + [" ".join(rnd.choice(["good", "fine", "bad", "x", "y", "z"][k % 2 :][:5]) for _ in range(rnd.randrange(1, 30))) for k in range(60)] + ["good fine " * 60_000]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, texts).where("doc_id in (7, 8)")).selectExpr("*", "1 AS kept", "2 AS log_weight")
    marks = [(k, int(k % 2 == 0)) for k in range(5, 45)] + [(5, 0), (None, 1), (6, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    good = {k for k, q in marks if q == 1 and k is not None}
    raw, target = collections.Counter(), collections.Counter()
    for k, t in rows:
        g = grams_by_force(t)
        raw.update(g)
        if k in good:
            target.update(g)
    n, m = sum(raw.values()), sum(target.values())
    p = lambda b: (raw[b] + 1) / (n + importance.BUCKETS)
    weight = {k: sum(np.log((target[b] + importance.PRIOR * p(b)) / (m + importance.PRIOR)) - np.log(p(b)) for b in grams_by_force(t)) for k, t in rows}
    out = importance.resampled(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        assert abs(r["log_weight"] - weight[r["doc_id"]]) < 1e-6 * max(1, abs(weight[r["doc_id"]]))
    share = sum(q == 1 for _, q in marks[:-2]) / len(marks[:-2])
    least = sorted((r["sample_key"] for r in out), reverse=True)[round(len(rows) * share) - 1]
    assert all(r["kept"] == (r["sample_key"] >= least) for r in out)
    noise = [r["sample_key"] - r["log_weight"] for r in out]
    assert len({round(x, 6) for x in noise}) == len(texts) and -4 < min(noise) and max(noise) < 12


# 9 language


def test_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en"), (9002, "12 34 !!", "en"), (9003, "", None)], "doc_id long, text string, lang string")
    every = docs.select("doc_id", "text", "lang").unionByName(odd)
    model = langid.fit(every)
    found = langid.predict(every, model).join(every.drop("text"), "doc_id")
    held = found.where(langid.held_out() & (F.col("doc_id") < 9000))
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    assert {r["lang_pred"] for r in found.where("doc_id > 9000").collect()} == {"und"}
    kept = langid.stage(docs.unionByName(odd, allowMissingColumns=True))
    assert kept.where("doc_id > 9000").count() == 0 and kept.count() >= 0.95 * docs.count()
    assert langid.predict(every, langid.fit(every.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_by_force(spark):
    """Predictions by plain naive Bayes over the same buckets, and a bounded fit on a small sample of all rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("lang_pred"), F.lit(1).alias("score"))
    odd = spark.createDataFrame([(None, "the cat", None), (9001, "Ein Haus. " * 40_000, None), (9002, "the", None), (9002, "the", None), (9003, "\u0130ß", None)], "doc_id long, text string, lang string")
    every = docs.unionByName(odd, allowMissingColumns=True)
    model = langid.fit(every)

    def buckets(text, order):
        low = [ord(x) if len(x := c.lower()) == 1 else ord(c) for c in text]
        out, mask = [], 0xFFFFFFFF
        for at in range(len(low) - order + 1):
            h = order * 0x9E3779B1 & mask
            for k in range(order):
                h = (h ^ low[at + k]) * 0x85EBCA6B & mask
                h ^= h >> 15
            out.append((h * 0xC2B2AE35 & mask) >> 17)
        return out

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in every.collect()]
    counts, seen = collections.defaultdict(collections.Counter), collections.Counter()
    for k, text, lang in rows:
        if lang is not None and zlib.crc32(str(k).encode()) % 5 != 0:
            seen[lang] += 1
            for order in langid.ORDERS:
                counts[lang].update(buckets(text, order))
    langs = sorted(seen)
    assert model["langs"] == langs
    total = {x: sum(counts[x].values()) + 0.5 * langid.BUCKETS for x in langs}
    found = collections.defaultdict(list)
    for r in langid.predict(every, model).collect():
        found[r["doc_id"]].append((r["lang_pred"], r["score"]))
    assert sum(map(len, found.values())) == len(rows)
    for k, text, _ in rows[:60] + rows[-5:]:
        cut = text[:3000] if k != 9001 else text
        if cut != text:
            continue
        logs = [np.log(seen[x] / sum(seen.values())) + sum(n * np.log((counts[x][b] + 0.5) / total[x]) for order in langid.ORDERS for b, n in collections.Counter(buckets(text, order)).items()) for x in langs]
        best = int(np.argmax(logs))
        share = 1 / sum(np.exp(np.minimum(0, np.array(logs) - logs[best])))
        assert found[k][0][0] == langs[best] and abs(found[k][0][1] - share) < 1e-3, k
    flags = every.select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in flags)


# 10 encoding


def test_bpe_against_library():
    from tokenizers import Tokenizer

    own, library = bpe.load(vocabulary()), Tokenizer.from_file(vocabulary())
    rnd = random.Random(2)
    bits = [*"aAb ΑΣς'İıḰ​　٣½!?\U0001f600한中ﬁé", "<|endoftext|>", "'S", "'re", " ", *map(chr, range(0xA0, 0x250))]
    for text in ["", "a" * 5000, *("".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(4000))]:
        ids = own.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark):
    docs = docs_of(spark, [None, "", "Hello there", "Hello there"]).withColumn("ids", F.lit("clash"))
    coded = bpe.encode(docs.drop("ids"), vocabulary())
    assert [len(r["ids"]) for r in coded.orderBy("doc_id").collect()] == [0, 0, 2, 2]
    assert [r["text"] for r in bpe.decode(coded, vocabulary()).orderBy("doc_id").collect()][2] == "hello</w> there</w>"
    out = bpe.stage(docs, vocabulary())
    assert out.columns[-3:] == ["n_tokens", "ids", "decoded"] and out.count() == 4
    assert bpe.digests(docs, vocabulary()).count() == 4


def test_bpe_digests_against_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(80).collect()] + [None, "", "Aé\u0301 \U0001f600", "word " * 100_000, "z" * 50_000]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["twice"])).selectExpr("*", "1 AS n_tokens", "2 AS ids")
    got = collections.defaultdict(set)
    for r in bpe.digests(docs, vocabulary()).collect():
        got[r["doc_id"]].add(tuple(r)[1:])
    for k, t in [*enumerate(texts), (0, "twice")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) in got[k]
    assert bpe.digests(docs.limit(0), vocabulary()).count() == 0


# pipeline


def test_pipeline_by_force(spark, tmp_path):
    """Every stage's decisions on a table whose rows have a known fate, and the ids of what is left."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    source = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) between 300 and 3000").orderBy("doc_id").select("doc_id", "text", "lang").limit(60).collect()]
    sets = sets_of([t for _, t, _ in source], 5)
    first = [k for k, c in enumerate(components_by_force(sets, 80)) if c == k]
    clean = [source[k] for k in first if "@" not in source[k][1] and "+" not in source[k][1]]
    clean = [r for r in clean if pii.all_spans(r[1])[1] == []]
    copied = clean[0][1]
    planted = [
        (9001, None, None),
        (9002, "12 34 !!", "en"),
        (9003, "", None),
        (9004, copied, clean[0][2]),
        (9005, copied + " end", clean[0][2]),
        (9006, f"{clean[1][1]}\n{ITEM}", clean[1][2]),
        (9007, f"Was that all of the things and more of them? Write to jane at example dot com or a@b.org, {clean[2][1][:60]}", "en"),
    ]
    rows = [(k, t, lang, "s", len(t or "")) for k, t, lang in clean + planted]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {k for k, _, _ in clean} | {9007}
    library = Tokenizer.from_file(vocabulary())
    for k, t, _ in [*clean, planted[-1]]:
        if k == 9007:
            t = t.replace("jane at example dot com", "<EMAIL>").replace("a@b.org", "<EMAIL>")
        ids = library.encode(t, add_special_tokens=False).ids
        assert out[k]["text"] == t and list(out[k]["ids"]) == ids and out[k]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert out[k]["n_chars"] == len(t)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, left, SMALL)
        assert after.columns == docs.columns
        n = left.count()
        left = spark.createDataFrame(after.toPandas(), docs.schema)
        assert 0.5 * n <= left.count() <= n, k
    out = corpus_pipeline.STAGES[-1][1](spark, left, SMALL)
    assert out.count() == left.count() and "decoded" in out.columns


def test_near_duplicates_without_stars(spark, monkeypatch):
    """Every pair of a node and a centre may be missed; the others are compared all the same."""
    monkeypatch.setattr(minhash, "_near", lambda batches: iter(()))
    rnd = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(base)]
    for _ in range(30):
        copy = list(base)
        for _ in range(rnd.randrange(1, 6)):
            copy[rnd.randrange(60)] = f"x{rnd.randrange(1000)}"
        texts.append(" ".join(copy))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, texts), 3, 85).collect()}
    assert [got[k] for k in range(len(texts))] == components_by_force(sets_of(texts, 3), 85)


@pytest.mark.parametrize(("n", "private"), [(250, True), (250, False)])
def test_near_duplicates_large_loose_group(spark, n, private):
    """A group whose members are mostly just below the threshold: links as by force, and few of its sets are compared."""
    rnd = random.Random(13)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for k in range(n):
        copy = list(base)
        for at in rnd.sample(range(100), rnd.randrange(3, 6)):
            copy[at] = f"own{k}x{at}" if private else f"x{rnd.randrange(3)}"
        texts.append(" ".join(copy))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, texts), 3, 85).collect()}
    assert [got[k] for k in range(n)] == components_by_force(sets_of(texts, 3), 85)


def test_similar_pairs_by_force():
    rnd = random.Random(12)
    for percent in (80, 85):
        for _ in range(60):
            base = [rnd.randrange(500) for _ in range(30)]
            sets = [np.unique(np.array([x if rnd.random() < 0.9 else rnd.randrange(500) for x in base], np.uint64)) for _ in range(14)]
            sides = np.array([rnd.randrange(1, 4) for _ in sets])
            comp = np.array([rnd.randrange(20) for _ in sets])
            root = {c: c for c in comp.tolist()}
            own = dict(root)

            def top(r, x):
                while r[x] != x:
                    x = r[x]
                return x

            for a, b in minhash.similar_pairs(sets, sides, comp, percent):
                assert top(own, comp[a]) != top(own, comp[b])
                own[top(own, comp[a])] = top(own, comp[b])
            for a in range(14):
                for b in range(14):
                    both = len(np.intersect1d(sets[a], sets[b]))
                    if sides[a] & 1 and sides[b] & 2 and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        root[top(root, comp[a])] = top(root, comp[b])
            same = lambda r: {frozenset(c for c in r if top(r, c) == t) for t in {top(r, c) for c in r}}
            assert same(own) == same(root)


def test_near_duplicates_very_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = docs_of(spark, [long, long + " end", "a b c d"]).selectExpr("*", "1 AS node", "2 AS component", "3 AS key", "4 AS n_shingles", "5 AS cluster")
    got = {r["doc_id"]: tuple(r) for r in minhash.near_duplicates(rows, 3, 85).collect()}
    assert got[0][2] == got[1][2] == 0 and got[1][1] == 299_999 and got[2][2:] == (2, True)
    left = minhash.stage(rows, 3, 85)
    assert left.columns == rows.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 2]
