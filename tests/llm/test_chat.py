"""Chat formatting: the template language, and an exact round trip of conversations."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from duskboard.llm import chat, queries
from duskboard.llm.template import TemplateError, compile_template, fold_body, parse

SMALL = "/root/testdata/sf0.001"

FILTERS = {"escape": chat.escape, "up": str.upper}


def rendered(source, **values):
    return compile_template(source, FILTERS)(values)[0]


@pytest.mark.parametrize(("source", "values", "wanted"), [
    ("{{ a }}-{{ b }}", {"a": 1}, "1-"),
    ("{% for x in xs %}{{ loop.index }}{{ x.n | up }}{% endfor %}", {"xs": [{"n": "a"}, {"n": "b"}]}, "1A2B"),
    ("{% if a == 'x' %}1{% elif a != none and not b %}2{% else %}3{% endif %}", {"a": "y"}, "2"),
    ("{% if a == 'x' %}1{% elif a != none and not b %}2{% else %}3{% endif %}", {}, "3"),
    ("{{ ('a' + 'b') | up + c }}", {"c": "!"}, "AB!"),
    ("a {%- if true -%} b {%- endif -%} c", {}, "abc"),
    ("{{ a.b.c }}{{ 'x\\n' }}", {"a": "text"}, "x\n"),
    ("{% for x in a %}{{ x }}{% endfor %}", {"a": "text"}, ""),
    ("{{ a.__class__ }}", {"a": {}}, ""),
])
def test_language(source, values, wanted):
    assert rendered(source, **values) == wanted


@pytest.mark.parametrize("source", ["{{ a.b() }}", "{{ }}", "{% if a %}", "{% while a %}{% endif %}", "{{ a | open }}", "{{ 'a }}", "{% for a %}{% endfor %}", "{{ a[0] }}"])
def test_what_is_not_allowed(source):
    with pytest.raises(TemplateError):
        compile_template(source, FILTERS)


def test_constants_are_folded():
    assert fold_body(parse("a{{ 'b' + ('c' | up) }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}e"), FILTERS) == [("text", "abCde")]


def test_generated_spans():
    text, spans = compile_template("<{% generation %}{{ a }}{% endgeneration %}>{% generation %}{% endgeneration %}", {})({"a": "héé"})
    assert (text, spans) == ("<héé>", [(1, 4)])


@given(st.text(alphabet=st.sampled_from(list("\\<|n\nab>"))))
def test_escapes_are_undone(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert "\n" not in chat.escape_line(text) and chat.unescape(chat.escape_line(text)) == text


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_all_conversations(spark, con):
    got = {r["conv_id"]: r for r in queries.op3_chat_templates(spark, SMALL).collect()}
    rows = con.execute("select conv_id, turn, coalesce(role, ''), coalesce(text, '') from conversations order by 1, 2").fetchall()
    rows += [(-1, 0, "user", queries.SMUGGLED), (-1, 1, "assistant", queries.SMUGGLED)]
    for conv, r in got.items():
        own = [(role, text) for c, _, role, text in rows if c == conv]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == digest("".join(f"{a}\n{b}\n" for a, b in own))
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == digest(loss) and r["formatted_chars"] > len(loss)
    assert set(got) == {c for c, *_ in rows}


def test_hard_conversations(spark):
    rows = [
        (1, 2, "assistant", "second\\n"), (1, 1, "user\nx", "<|im_end|>\n"), (1, 1, "user\nx", "<|im_end|>\n"), (2, None, None, None),
        (None, 1, "assistant", "no id"), (3, 1, "assistant", "y" * 300_000), (4, 1, "assistant", ""),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS formatted", "2 AS n_turns")
    out = {r["conv_id"]: r for r in chat.format_chats(turns).collect()}
    assert chat.parse_chat(out[1]["formatted"]) == [("user\nx", "<|im_end|>\n")] * 2 + [("assistant", "second\\n")]
    assert chat.parse_chat(out[2]["formatted"]) == [("", "")] and out[4]["loss_spans"] == []
    start, end = out[3]["loss_spans"][0]
    assert out[3]["formatted"][start:end] == "y" * 300_000 and out[None]["n_turns"] == 1
    assert chat.read_chats(chat.format_chats(turns.filter("conv_id > 9"))).count() == 0
