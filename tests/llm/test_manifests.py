"""Filter audits, chat formatting and Merkle manifests against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.llm import chat_format, filter_audit, merkle
from parley.llm.ranks import number
from tests.llm import brute
from tests.llm.conftest import make_documents

PARTS = "doc_id long, source string, text string, part string, word string, n long, fails int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_filters_in_all_orders(spark, labels):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "a", "b", None, ""]), t) for i, t, *_ in make_documents()]
    rows += [rows[0]] * 40 + [(None, "a", ""), (-5, "b", rows[3][2]), (-5, "b", rows[4][2]), (7, "c", "A B C % " * 100)]
    told = [tuple(r) for r in labels.collect()] + [(6, 0, 1), (6, 1, 0)]
    docs = spark.createDataFrame([(*r, "p", "w", 1, 2) for r in rows], PARTS).repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(told, "doc_id long, quality int, toxic int"))
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()}
    assert found == brute.filter_audit(rows, told)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_word_totals_of_equal_rows(spark):
    rows = [(1, 9, "a b a")] * 50 + [(None, 8, ""), (None, 7, "x"), (2, 7, "x  y\tx")]
    docs = spark.createDataFrame(rows, "doc_id long, _h long, text string").repartition(8)
    got = {tuple(r) for r in filter_audit.word_totals(docs, 1000).collect()}
    assert got == {(1, 9, 3, 2), (None, 8, 0, 0), (None, 7, 1, 1), (2, 7, 3, 2)}


def test_positions_in_groups_of_any_size(spark):
    rows = [("big", i % 700, i) for i in range(2000)] + [(f"g{i}", i, i) for i in range(30)] + [("n", None, 1), ("n", 0, 2)]
    got = number(spark.createDataFrame(rows, "g string, o long, x long").repartition(7), ["g"], ["o", "x"], "t").collect()
    groups = defaultdict(list)
    for r in sorted(got, key=lambda r: r["_pos"]):
        groups[r["g"]].append((r["_pos"], r["_size"], r["o"], r["x"]))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = {g: sorted(((o, x) for n, o, x in rows if n == g), key=key) for g in groups}
    assert all([(i, len(w), *r) for i, r in enumerate(w)] == groups[g] for g, w in want.items()) and len(got) == len(rows)


TEXT = st.text(alphabet="\\#<>/turn: aß\n🙂", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=6))
def test_templates_read_back(turns):
    text = chat_format.marked(turns)
    assert chat_format.read_back(text) == turns
    assert text.count("</turn>") == len(turns) and text.count("###") == len(turns)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), TEXT), max_size=9), st.integers(1, 4))
def test_loss_spans_are_the_assistants_texts(turns, window):
    out, roles, spans, loss, rewrites = chat_format.render_conversation(chat_format.marked, turns, window=window)
    assert out == chat_format.marked(turns) and not rewrites and roles == [r for r, _ in turns]
    assert [chat_format.unescape(out[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
    assert "".join(out[a:b] for a, b in spans) == out


def test_templates_with_an_opening_or_that_rewrite():
    opened = lambda turns, start: ("<s>" if start == 0 else "") + "".join(f"[{r}]{t}." for r, t in turns)
    out, _, spans, loss, rewrites = chat_format.render_conversation(opened, [("user", "q"), ("assistant", ".]a"), ("user", "z")], window=2)
    assert out == "<s>[user]q.[assistant].]a.[user]z." and not rewrites and [out[a:b] for a, b in loss] == [".]a"] and spans[0][0] == 0
    # This one drops what an assistant said once the user has answered.
    last = lambda turns, start: "".join(f"[{r}]{t}." for i, (r, t) in enumerate(turns) if r == "user" or i == len(turns) - 1)
    assert chat_format.render_conversation(last, [("user", "q"), ("assistant", "a")])[-1] is False
    assert chat_format.render_conversation(last, [("user", "q"), ("assistant", "a"), ("user", "b")])[-1] is True
    # And this one joins two turns of one role, which shows at the seam of windows.
    joined = lambda turns, start: "".join(("" if i and turns[i - 1][0] == r else f"[{r}]") + t for i, (r, t) in enumerate(turns))
    assert chat_format.render_conversation(joined, [("user", "q"), ("user", "a")], window=1)[-1] is True


def chats():
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice([None, "", "hi", "\\# </turn>", "é🙂" * 50])) for c in range(40) for t in range(rnd.randint(1, 6))]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (50, 1, "assistant", "x" * 100_000)]
    return rows + [(99, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]


@pytest.mark.parametrize("long", [50, 4096])
def test_conversations_are_digested(spark, long):
    rows = chats()
    table = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, part long, formatted string").repartition(3)
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        want[conv] = (len(turns), h("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), h(loss), len(chat_format.marked([(r, x) for *_, r, x in turns])))
    assert {r[0]: tuple(r)[1:] for r in chat_format.digests(table, long).collect()} == want
    assert chat_format.digests(table.limit(0)).count() == 0
    formatted = chat_format.format_chats(table, long=long).collect()
    assert sum(r["n_turns"] for r in formatted) == len(rows) and not any(r["rewrites"] for r in formatted)
    assert all(len(r["spans"]) == r["n_turns"] == len(r["roles"]) for r in formatted)
    assert sorted(r["part"] for r in formatted if r["conv_id"] == 99) == ([1, 2, 3, 4, 5, 6] if long == 50 else [0])


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 16])
def test_traversal_gives_every_path_with_few_nodes(size):
    leaves = [h(str(i)) for i in range(size)]
    root, _, proofs = brute.merkle({"": leaves})
    height = merkle.height_of(size, 12)
    assert list(merkle.paths(leaves, height)) == [p[2] for p in proofs]
    assert merkle.begin(leaves, height)[0] == root
    stacks = merkle.begin(leaves, height)[2]
    for _ in range(4 * size):
        for level, stack in enumerate(stacks):
            stack.step()
            assert len(stack.stack) <= level + 2


@pytest.mark.parametrize("height", [2, 12])
def test_manifests_are_proved(spark, height):
    rnd = random.Random(1)
    rows = [(i, t, rnd.choice(["en", "en", "fr", None, "de", "ß"]), rnd.choice(["s", None, ""]), n if i is None or i % 4 else None) for i, t, _, _, n, *_ in make_documents()]
    rows += [(5000, "only", "xx", "s", 4), rows[2], rows[2]]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, path string, digest int").repartition(3)

    def leaf(i, text, lang, source, n):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    groups = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
        groups[b"" if r[2] is None else b"=" + r[2].encode()].append((r[0] is not None, r[0] or 0, leaf(*r), leaf(*r[:4], r[4] + hit) if r[4] is not None else leaf(*r)))
    groups = {g: sorted(x) for g, x in groups.items()}
    root, subroots, proofs = brute.merkle({g: [r[2] for r in x] for g, x in groups.items()})
    want = Counter()
    for g, i, siblings, rights in proofs:
        known, doc_id, whole, folded = groups[g][i]
        for s, right in zip(siblings, rights, strict=True):
            folded = h(folded if s is None else s + folded if right else folded + s)
        want[(doc_id if known else None, whole, subroots[g], root, h("".join(s or "" for s in siblings)), folded, folded == root)] += 1
    got = Counter(tuple(r) for r in merkle.verify(docs, height).collect())
    assert got == want and any(not r[-1] for r in got)
    assert merkle.verify(docs.limit(0), height).count() == 0


def test_several_labels_of_a_document_are_settled(spark):
    from parley.llm import quality_rules

    told = [(1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 1), (3, None, 1), (4, 0, 0), (None, 0, 1)]
    labels = spark.createDataFrame(told * 3, "doc_id long, quality int, toxic int").repartition(3)
    assert {(r["doc_id"], r["quality"]) for r in quality_rules.chosen_labels(labels).collect()} == {(1, 0), (2, 1), (4, 0)}


def test_sketches_tell_how_much_is_kept(spark):
    from parley.llm import fingerprints

    prose = [" ".join(f"{c}{i}" for i in range(60)) for c in "ab"]
    docs = spark.createDataFrame([(1, prose[0]), (2, prose[0] + " " + prose[1]), (3, ""), (4, "one two")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs).collect()}
    assert [got[i]["distinct_shingles"] for i in (1, 2, 3, 4)] == [56.0, 116.0, 0.0, 1.0]
    assert got[1]["kept_in_next"] == 1.0 and got[2]["kept_in_next"] == 0.0 and got[3]["kept_in_next"] == 1.0 and 0.3 < got[1]["kept_in_edited"] < 0.7
