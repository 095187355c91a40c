from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from linetally.llm import chat

NASTY = st.lists(st.sampled_from([*"\\#</turn>: \nasé", "### ", "</turn>\n", "\\\\"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(turns=st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), NASTY), NASTY), max_size=5))
def test_any_text_reads_back(turns):
    text, spans = chat.compile_template(chat.TURNS)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert chat.read_turns(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@settings(max_examples=200, deadline=None)
@given(text=NASTY)
def test_escaped_texts_hold_no_control_string(text):
    plain = chat.escape(text).replace("\\\\", "").replace("\\#", "").replace("\\<", "")
    assert "###" not in plain and "</turn>" not in plain and chat.unescape(chat.escape(text)) == text


@pytest.mark.parametrize(
    ("template", "data", "want"),
    [
        ("a{{ 1 + 2 }}{{ 'x' + 'y' }}b", {}, "a3xyb"),
        ("{% if a %}1{% elif b == 'x' %}2{% else %}3{% endif %}", {"b": "x"}, "2"),
        ("{% if a %}1{% elif b == 'x' %}2{% else %}3{% endif %}", {}, "3"),
        ("{% for x in xs %}{{ loop.index }}{{ x.n }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": [{"n": "a"}, {"n": "b"}]}, "1a,2b"),
        ("{{ a.b['c'] }}|{{ a.none }}|{{ a.b.c.d }}", {"a": {"b": {"c": "v"}}}, "v||"),
        ("{{ ' X ' | trim | lower }}{{ n | default('d') }}{{ xs | length }}", {"xs": [1, 2]}, "xd2"),
        ("{# note #}{{ 'a' in 'cab' and not false }}", {}, "true"),
        ("{{ a or 'z' }}{{ (1 < 2) and 'y' }}{{ \"q\\n\" }}", {}, "zyq\n"),
        ("{% for x in nothing %}never{% endfor %}", {}, ""),
        ("{{ 'a' < 1 }}{{ none >= 1 }}{{ x <= 2 }}{{ 1 < 2 }}{{ 'b' > 'a' }}", {}, "falsefalsefalsetruetrue"),
        ("{{ xs in d }}{{ d[xs] }}{{ 'k' in d }}", {"xs": [1], "d": {"k": 1}}, "falsetrue"),
    ],
)
def test_templates(template, data, want):
    assert chat.compile_template(template)(data)[0] == want


def test_constants_are_folded():
    tree = chat.fold_tree(chat.parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{% if false %}d{% endif %}{{ 'e' + 1 }}"))
    assert tree == [("text", "aBce1")]
    assert chat.fold_tree(chat.parse("{{ x + ('a' + 'b') }}"))[0][1][2] == ("const", "ab")


@pytest.mark.parametrize("template", ["{{ a.__class__ }}", "{{ x | system }}", "{{ f() }}", "{% import os %}", "{% for x in y %}", "{% endif %}", "{{ 1 + }}", "{{ a b }}", "{{ $ }}", "{% generation %}{% endfor %}", "{{ " + "(" * 3000 + "1" + ")" * 3000 + " }}", "{{ " + "not " * 2000 + "1 }}", "{{ 1" + " + 1" * 3000 + " }}", "{% if a %}" * 500 + "{% endif %}" * 500, "{{ x | upper('a') }}", "{{ x | default(1, 2) }}", "{{ " + "9" * 5000 + " }}", "{{ 'a' + (1 }}", "{{ a[ }}", "{{ a. }}"])
def test_the_sandbox_and_errors(template):
    if template == "{{ a.__class__ }}":  # only items of data are reached
        assert chat.compile_template(template)({"a": "text"})[0] == ""
    else:
        with pytest.raises(chat.TemplateError):
            chat.compile_template(template)


def test_conversations_end_to_end(spark):
    probe = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo ###"), (1, 1, "assistant", "yo ###"), (2, 5, None, None), (None, 0, "user", "a"), (None, None, "assistant", "first")]
    rows += [(-7, 0, "user", probe), (-7, 1, "assistant", probe)] + [(3, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(500)]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, conv int").repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv, r in got.items():
        own = sorted([(-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv])
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    whole = {r["conv_id"]: r["text"] for r in chat.format_conversations(turns).collect()}
    assert whole[1] == "### user: hi</turn>\n" + "### assistant: yo \\###</turn>\n" * 2 and whole[2] == "### : </turn>\n"
    assert got[3]["formatted_chars"] == len(whole[3])
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0
    own = chat.format_conversations(turns, "{% for m in messages %}[{{ m.role }}]{{ m.text | escape }}{% endfor %}").where("conv_id = 1")
    assert own.collect()[0]["text"].startswith("[user]hi[assistant]yo")
