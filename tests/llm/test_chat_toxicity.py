"""Linked quotations and the learned lexicon on small conversations and texts."""

import math
import random
import zlib
from collections import defaultdict

import pytest

from hinloom.llm import chat, toxicity

MESSAGES = [
    (1, 0, "user", "How do I sort a list?\nIt has numbers."),
    (1, 1, "assistant", "> How do I sort a list?\nUse sorted."),
    (1, 2, "user", "Another topic: how do I reverse a list?"),
    (1, 3, "assistant", "> > How do I sort a list?\n> Use sorted.\nSee above."),
    (1, 4, "assistant", "On Monday, a user wrote:\n>Another  TOPIC: how do\n>I reverse a list?\n\nUse reversed."),
    (1, 5, "user", "> nobody said this\nReally?"),
    (1, 6, "user", "> Use reversed.\n> See above.\nThanks"),
    (2, 0, "user", "Use sorted."),
    (2, 1, "user", ">> Use sorted.\nonly a deeper level"),
    (2, 2, "user", None),
    (2, 3, "user", ""),
    (2, 4, "user", "> Use sorted."),
    (3, 0, "user", "> later text\nfirst"),
    (3, 1, "user", "later text"),
]


def test_threads_of_quotations(spark):
    df = spark.createDataFrame([(*m, 7) for m in MESSAGES], "conv_id long, turn long, role string, text string, root int")
    got = {(r.conv_id, r.turn): r for r in chat.reply_ordered(df).collect()}
    assert len(got) == len(MESSAGES)
    links = {k: r.reply_to for k, r in got.items() if r.reply_to is not None}
    assert links == {(1, 1): 0, (1, 3): 1, (1, 4): 2, (1, 6): 4, (2, 1): 0, (2, 4): 0}
    order = sorted((r.conv_id, r.position, r.turn, r.root, r.depth) for r in got.values())
    assert [o[:1] + o[2:] for o in order if o[0] == 1] == [
        (1, 0, 0, 0), (1, 1, 0, 1), (1, 3, 0, 2), (1, 2, 2, 0), (1, 4, 2, 1), (1, 6, 2, 2), (1, 5, 5, 0),
    ]
    assert [o[1] for o in order if o[0] == 2] == list(range(5))
    assert got[1, 4].text == "Use reversed." and got[1, 4].quotes == 1
    assert got[1, 3].text == "See above." and got[1, 3].quotes == 2
    assert got[2, 2].text == "" and got[2, 4].text == "" and got[1, 0].text == MESSAGES[0][3]


def test_long_chains_equal_a_loop(spark):
    draw = random.Random(8)
    rows, parent = [], {}
    for turn in range(120):
        text = f"statement number {turn}"
        if turn and draw.random() < 0.8:
            parent[turn] = draw.randrange(max(0, turn - 3), turn)
            text = f"> statement number {parent[turn]}\n{text}"
        rows.append((9, turn, "user", text))
    got = chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in got:
        root, depth = r.turn, 0
        while root in parent:
            root, depth = parent[root], depth + 1
        assert (r.reply_to, r.root, r.depth, r.text) == (parent.get(r.turn), root, depth, f"statement number {r.turn}")
    place = {r.turn: r.position for r in got}
    assert sorted(place.values()) == list(range(120)) and all(place[t] > place[p] for t, p in parent.items())


def test_conversations_that_quote_equal_a_loop(spark):
    """Every turn of `conversations` quotes an earlier one with what that one quoted, to a known depth."""
    draw = random.Random(4)
    said = defaultdict(dict)
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect():
        said[r.conv_id][r.turn] = r.text
    rows, parent, own = [], {}, {}
    for conv, turns in said.items():
        full = {}
        for k, turn in enumerate(sorted(turns)):
            own[conv, turn] = f"turn {turn} of {conv}:\n{turns[turn]}" if turns[turn].strip() else f"turn {turn} of {conv}"
            full[turn] = own[conv, turn]
            if k and draw.random() < 0.8:
                to = draw.choice(sorted(turns)[:k])
                parent[conv, turn] = to
                wrapped = [line.upper() if draw.random() < 0.3 else line for line in full[to].split("\n")]
                full[turn] = "\n".join([f"On day {turn}, someone wrote:", *(f"> {line}" for line in wrapped), own[conv, turn]])
            rows.append((conv, turn, "user", full[turn]))
    got = chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows) and len(parent) > 40
    for r in got:
        root, depth = r.turn, 0
        while (r.conv_id, root) in parent:
            root, depth = parent[r.conv_id, root], depth + 1
        want = (parent.get((r.conv_id, r.turn)), root, depth, depth, own[r.conv_id, r.turn])
        assert (r.reply_to, r.root, r.depth, r.quotes, r.text) == want


def test_a_very_long_message_is_parsed_whole(spark):
    long = "\n".join(f"line {k} of a long message" for k in range(20000))
    rows = [(1, 0, "user", long), (1, 1, "user", "\n".join(f"> {x}" for x in long.split("\n")) + "\nyes"), (1, 2, "user", "> line 19999 of a long message\nno")]
    got = {r.turn: r for r in chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[t].reply_to, got[t].text) for t in (1, 2)] == [(0, "yes"), (0, "no")] and got[0].text == long


def test_missing_keys_repeats_and_no_messages(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 1, "user", "a"), (None, 1, None, "> a"), (1, None, "user", "> b"), (1, 2, "user", "b"), (1, 2, "user", "b"), (1, 3, "user", "> b")]
    got = chat.reply_ordered(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6
    assert [(r.turn, r.reply_to) for r in got if r.reply_to is not None] == [(3, 2)]
    assert sorted(r.position for r in got if r.conv_id == 1) == [0, 1, 2, 3]
    assert chat.reply_ordered(spark.createDataFrame(rows, schema).limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        ("You 1D10T!", " you idiot "), ("ѕсum", " scum "), ("M0r0n", " moron "), ("$tupid tr@sh", " stupid trash "),
        ("ｌｏｓｅｒ", " loser "), ("in 2024, room 12", " in 2024 room 12 "), ("слово", " слово "), ("", "  "), ("Été", " été "),
    ],
)
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def test_hits_weights_and_exceptions():
    lexicon = toxicity.Lexicon({" trash ": 4.0, " tra": 2.0, " lowei": 5.0}, ("trash can",))
    assert lexicon.hits("a trash b") == (4.0, 3)
    assert lexicon.hits("the trash can is full of tr4sh") == (4.0, 7)
    assert lexicon.hits("loweib LOWEIC alowei travel") == (12.0, 4)
    assert lexicon.hits("") == (0.0, 0)
    assert lexicon.score("trash") > lexicon.score("trash " + "word " * 500) > lexicon.score("word")


def test_hits_equal_a_substring_loop():
    draw = random.Random(6)
    pieces = ["tra", "trash", "can", "bin", "idiot", "fool", "a", "the", "idio", "tr4sh", "!", "scum"]
    terms = {" trash ": 4.0, " tra": 2.0, " idio": 3.0, " idiot ": 5.0, " fool": 1.5, " a ": 0.5}
    exceptions = ("trash can", "the fool", "a")
    lexicon = toxicity.Lexicon(terms, exceptions)
    for _ in range(500):
        text = " ".join(draw.choice(pieces) + draw.choice(["", "", "s"]) for _ in range(draw.randrange(12)))
        folded = toxicity.fold(text)
        harmless = [(i, i + len(p) - 1) for e in exceptions for p in [toxicity.fold(e)] for i in range(len(folded)) if folded.startswith(p, i)]
        total = 0.0
        for i in range(len(folded)):
            found = [w for t, w in terms.items() if folded.startswith(t, i)]
            if found and not any(x <= i < y for x, y in harmless):
                total += max(found)
        weight, words = lexicon.hits(text)
        assert words == len(folded.split()) and abs(weight - total) < 1e-9


def test_learning_counts_equal_a_loop(spark):
    docs, labels = corpus(random.Random(7), 120)
    docs += [(504, "z" * 3000 + " idiot", "en", "s"), (501, "", "en", "s"), (502, None, "en", "s")]
    labels += [(504, 1, 1), (501, 0, 0), (502, 0, 1)]
    training = toxicity.training_rows(
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )
    toxic = {i: t for i, _, t in labels}
    first = {}
    for doc, text, *_ in sorted(docs):
        if zlib.crc32(str(doc).encode()) % 4 == 2:
            continue
        words = toxicity.fold(text or "").split()
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            first.setdefault((word, before, after), doc)
    uses = defaultdict(set)
    for (word, *_), doc in first.items():
        for term in toxicity.beginnings(word):
            uses[term, doc].add(word)
    want = defaultdict(lambda: [0, 0, 0.0, 0.0])
    for (term, doc), words in uses.items():
        want[term][1 - toxic[doc]] += 1
        want[term][3 - toxic[doc]] += math.log2(1 + len(words))
    got = {r.term: (r.a, r.b, r.more_a, r.more_b) for r in toxicity.counted(toxicity._terms(toxicity._words(training))).collect()}
    assert got.keys() == want.keys() and " " + "z" * 3000 + " " in got
    assert all(x == pytest.approx(want[t], abs=1e-5) for t, x in got.items())


def test_beginnings_of_words_of_any_length():
    assert toxicity.beginnings("ab") == [" ab "] and toxicity.beginnings("abcd") == [" abcd ", " abc"]
    many = toxicity.beginnings("x" * 10000)
    assert sum(map(len, many)) < 6 * 10000 and len(many) < 40 and {len(t) - 1 for t in many[1:]} >= {3, 4, 5, 6, 8}


def test_exceptions_are_learned(spark):
    """A word that is harmless with another one: its other uses still count, and these do not."""
    draw = random.Random(9)
    filler = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    docs, labels = [], []
    for i in range(1200):
        words, toxic = filler(20), i % 6 == 0
        if toxic and i % 12 == 0:
            words.insert(draw.randrange(1, 19), "trash")
        if draw.random() < 0.1:
            at = draw.randrange(1, 19)
            words[at:at] = ["trash", "can"]
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    lexicon = toxicity.learn(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert lexicon.exceptions == ("trash can",) and " trash " in lexicon.terms
    assert lexicon.hits("the trash can")[0] == 0.0 < lexicon.hits("you trash")[0]


def test_few_labels_are_enough_for_most_toxic_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p for p, t in held if t) / sum(t for _, t in held) > 0.7
    assert sum(p for p, t in held if not t) <= 1


def corpus(draw, count):
    syllables = ["an", "er", "th", "on", "re", "ing", "ou", "st", "ha", "en", "ti", "es"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4)))
    docs, labels = [], []
    for i in range(count):
        words = [word() for _ in range(draw.randrange(20, 200))]
        toxic = draw.random() < 0.15
        for _ in range(draw.randrange(2, 6) if toxic else 0):
            bad = draw.choice(["idiot", "1d1ot", "scum", "scуm".replace("у", "u"), "veju" + word(), "trash"])
            words.insert(draw.randrange(len(words)), bad)
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    # Copies of one toxic text: its harmless words must not become terms.
    special = "zzq unusual harmless words xxv " * 3 + "idiot scum"
    docs += [(count + i, special + f" tail{i}", "en", "s") for i in range(60)]
    labels += [(count + i, 1, 1) for i in range(60)]
    return docs, labels


def test_a_lexicon_is_learned_and_holds_on_other_rows(spark):
    docs, labels = corpus(random.Random(5), 900)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(d, t)
    assert {" idiot ", " scum ", " trash ", " veju"} <= set(lexicon.terms)
    assert not any("zzq" in term or "xxv" in term or "unus" in term for term in lexicon.terms)
    truth = {i: x for i, _, x in labels}
    got = toxicity.score(d, lexicon).collect()
    held = [r for r in got if r.held_out]
    assert 0.15 < len(held) / len(got) < 0.35
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    kept = {r.doc_id for r in toxicity.without_toxic(d, lexicon).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_labels_of_held_out_rows_are_not_learned_from(spark):
    docs, labels = corpus(random.Random(5), 300)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    flipped = t.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(d, t).terms == toxicity.learn(d, flipped).terms


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "idiot", "x"), (3, "word " * 30000, "x"), (3, "word", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(d, none)
    assert lexicon.terms == {}
    got = toxicity.score(d, lexicon).collect()
    assert len(got) == 5 and all(r.predicted == 0 for r in got)
    assert toxicity.score(d.limit(0), lexicon).count() == 0
    kept = toxicity.without_toxic(d, toxicity.Lexicon({" idiot ": 9.0}))
    assert kept.columns == d.columns and kept.count() == 4
