"""Operator 13: the template compiler, and formatting against a plain version."""

from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from emporia.llm import chat_formatting as cf
from emporia.llm.chat_template import UNDEFINED, Template, TemplateError, fold, parse

ROWS = "conv_id bigint, turn bigint, role string, text string, head string, segment int"


def test_expressions_and_statements():
    def out(source, **values):
        return Template(source).render(values.pop("messages", []), **values)[0]

    assert out("{{ 1 + 2 * 3 - -4 }} {{ 7 // 2 }}{{ 7 % 2 }}") == "11 31"
    assert out("{{ 'a' ~ 1 ~ true ~ none }}") == "a1true"
    assert out("{{ x if y else 'z' }}", x=1) == "z" and out("{{ x or 'd' }}") == "d" and out("{{ not x and 'n' }}") == "n"
    assert out("{{ a.b[1].c }}", a={"b": [0, {"c": "deep"}]}) == "deep"
    assert out("{{ a[-1] }}{{ a[9] }}", a=["p", "q"]) == "q"
    assert out("{% for x in a %}{{ loop.index }}{{ x }}{% if not loop.last %}, {% endif %}{% endfor %}", a=["p", "q"]) == "1p, 2q"
    assert out("{% if x == 1 %}one{% elif x == 2 %}two{% else %}more{% endif %}", x=2) == "two"
    assert out("{% set x = 'v' %}{% if true %}{% set x = 'w' %}{{ x }}{% endif %}{{ x }}") == "wv"
    assert out("a {#- gone {{ #} b  {%- set q = 1 -%}  c {{- q -}} d") == "a bc1d"
    assert out("{{ '}}' }}{{ \"%}\\n\" }}") == "}}%}\n"
    assert out("{{ x is defined }}{{ x is not defined }}", x=None) == "truefalse"
    assert out("{{ ' Ab ' | trim | upper }}{{ 'abc' | length }}{{ 'b' in 'abc' }}{{ 'k' in m }}", m={"k": 1}) == "AB3truetrue"
    assert out("{{ 1 == true }}{{ '1' == 1 }}{{ 2 >= 1 }}") == "falsefalsetrue"


@pytest.mark.parametrize("source", ["{{ x", "{% if x %}", "{% endif %}", "{{ 1 + }}", "{{ x | nothing }}", "{{ (1 }}", "{% for in x %}{% endfor %}",
                                    "{{ f(x) }}", "{% include 'a' %}", "{{ 1 2 }}", "{{ @ }}", "{% for x in a %}{% else %}{% endfor %}"])
def test_wrong_templates(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_sandbox():
    class Leak:
        secret = "s"

    assert Template("{{ x.secret }}{{ x.__class__ }}{{ 'a'.__class__ }}{{ m.keys }}").render([], x=Leak(), m={})[0] == ""
    for source in ("{{ x }}", "{% for c in 'abc' %}{% endfor %}", "{{ 1 // 0 }}", "{{ 'a' * 9 }}", "{{ 99999999 * 99999999 }}", "{{ 'a' < 1 }}"):
        with pytest.raises(TemplateError):
            Template(source).render([], x=Leak())
    assert Template("{% if false %}{{ 1 // 0 }}{% endif %}ok").render([])[0] == "ok"  # wrong only if it is reached


def test_constants_are_folded():
    tree = fold(parse("a{{ 'b' ~ 1 + 1 }}{% if 1 == 1 %}c{{ 'D' | lower }}{% else %}{{ x }}{% endif %}{# no #}e", {"lower": lambda v: v.lower()}), {"lower": lambda v: v.lower()})
    assert tree == ("body", [("write", ("const", "ab2cde"))])
    assert fold(("choose", ("const", UNDEFINED), ("name", "a"), ("name", "b")), {}) == ("name", "b")


def test_generation_spans_and_streams():
    source = "<{% for m in messages %}{{ loop.index }}{% generation %}{{ m.t }}{% endgeneration %}{% if loop.last %}!{% endif %}{% endfor %}>"
    t = Template(source)
    messages = [{"t": "é"}, {"t": "bc"}, {"t": ""}]
    text, spans = t.render(messages)
    assert text == "<1é2bc3!>" and [text[a:b] for a, b in spans] == ["é", "bc", ""]
    parts = list(t.stream(messages))
    assert t.streams and "".join(p for p, _ in parts) == text and [p[a:b] for p, s in parts for a, b in s] == ["é", "bc", ""]
    assert list(t.stream([])) == [("<>", [])]
    assert not Template("{% for m in messages %}{{ messages | length }}{% endfor %}").streams
    assert not Template("{% if x %}{% for m in messages %}{% endfor %}{% endif %}").streams


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<\\|>nia\n", max_size=12), st.text(alphabet="<\\|n\n ", max_size=8))
def test_shields_are_reversible(text, role):
    assert "<|" not in cf.shielded(text) and cf.unshielded(cf.shielded(text)) == text
    label = cf.labelled(role)
    assert "\n" not in label and "<|" not in label and cf.unlabelled(label) == role
    whole, spans = Template(cf.TEMPLATE, cf.FILTERS).render([{"role": role, "text": text}, {"role": "assistant", "text": text}])
    got = list(cf.turns_of(whole))
    assert [(r, t) for r, t, _, _ in got] == [(role, text), ("assistant", text)] and spans[-1] == got[1][2:]


def conversations():
    rng = random.Random(3)
    parts = [cf.OPEN, cf.CLOSE, "<|", "<\\|", "\\", "\n", "é", "word ", "<", "|"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "sys\ntem<|"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))))
            for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, t, "user" if t % 2 else "assistant", f"t{t} " * (t % 50)) for t in range(900)]  # a long one
    rows += [(101, 5, "assistant", "same")] * 40 + [(102, None, "user", "first"), (102, 1, None, None), (None, 1, "assistant", "x"), (None, 0, "user", "y")]
    rows += [(103, 1, "assistant", "z" * 100 + k) for k in "ba"] + [(103, 1, "assistant", k) for k in "ba"] + [(104, 0, "assistant", "long " * 400_000)]
    rng.shuffle(rows)
    return [(*r, "mine", 7) for r in rows]


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text, *_ in rows if k == c))
        turns = "".join(f"{r}\n{t}\n" for *_, r, t in own)
        loss = "".join(t for *_, r, t in own if r == "assistant")
        size = sum(len(cf.OPEN + cf.labelled(r) + "\n" + cf.shielded(t) + cf.CLOSE + "\n") for *_, r, t in own)
        out[c] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)
    return out


@pytest.mark.parametrize("long", [100_000, 30])
def test_formatting_equals_brute_force(spark, monkeypatch, long):
    rows = [r for r in conversations() if r[0] != 103]  # 103: ties by hash
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in cf.digests(df, long=long).collect()}
    want = brute(rows)
    assert got == want
    whole, cut = cf.formatted(df, long=long)
    if long == 30:
        n = {r.conv_id: r.n for r in cut.groupBy("conv_id").agg({"segment": "max"}).withColumnRenamed("max(segment)", "n").collect()}
        assert n[100] == 29 and set(n) == {100, 101}
    else:
        assert cut is None
    assert cf.digests(df.limit(0)).count() == 0


def test_ties_lose_nothing(spark):
    rows = [r for r in conversations() if r[0] == 103]
    df = spark.createDataFrame(rows, ROWS)
    a, b = (cf.digests(x).collect() for x in (df, df.orderBy("text").repartition(3)))
    assert a == b and a[0].n_turns == 4 and a[0].loss_chars == 204


def test_cut_conversations_know_their_places(spark):
    df = spark.createDataFrame([(1, t, "user", "x") for t in range(200)], "conv_id bigint, turn bigint, role string, text string")
    source = "{% for m in messages %}{% if loop.first %}[{% endif %}{{ loop.index }} {% if loop.last %}]{% endif %}{% endfor %}."
    _, cut = cf.formatted(df, source, long=20)
    rows = sorted(cut.collect(), key=lambda r: (r.segment, r.piece))
    assert len(rows) == 10 and "".join(r.text for r in rows) == "[" + "".join(f"{i} " for i in range(1, 201)) + "]."
    whole, _ = cf.formatted(df, "{{ messages | length }}{% for m in messages %}{{ m.text }}{% endfor %}")
    assert whole.first().text == "200" + "x" * 200
