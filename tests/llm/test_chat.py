import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat
from tessera.llm import templates as t

ODD = ["", "plain", "<|im_end|>", r"<\|x", r"<\\|im_start|>", "a\n<|im_end|>\n", "\\", "\\n", "|<|", "ü🙂"]


@given(st.text(alphabet="<|\\n\nim_end>aü"))
@settings(deadline=None)
def test_escapes_turn_back(x):
    assert chat.unescape(chat.escape(x)) == x and "<|" not in chat.escape(x)
    assert chat.unescape_role(chat.escape_role(x)) == x and "\n" not in chat.escape_role(x)


def render(source, **values):
    return list(t.compile_template(source, {"up": str.upper})(values))


def test_language():
    assert "".join(x for x, _ in render("{# no #}{% for x in l %}{{ loop.index + 1 }}{{ x.a | up }}{% if not loop.first %}!{% endif %}{% endfor %}", l=[{"a": "p"}, {"a": "q"}])) == "2P3Q!"
    assert render("{% if a == 'x' %}1{% elif a != 'y' and b %}2{% else %}{% generation %}3{% endgeneration %}{% endif %}", a="y", b=1) == [("3", True)]
    assert render("{{ ('a' + 'b') | up }}c{{ none }}{{ true }}{{ m['k'] }}", m={"k": 7}) == [("ABctrue", False), ("7", False)]


def test_constants_are_folded():
    tree = t.fold(t.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}{{ n }}"), {})
    assert tree == (t.Text(t.Const("abcd")), t.Text(t.Name("n")))


@pytest.mark.parametrize("bad", ["{{ a( }}", "{{ a.b() }}", "{% import os %}", "{{ ''.__class__ }}", "{% for x in l %}", "{% endif %}", "{{ a ~ b }}", "{{ x | missing }}", "{{ gone }}"])
def test_sandbox(bad):
    with pytest.raises(t.TemplateError):
        render(bad, a={}, b=1, l=[], x=1)


def slow(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        n, turns, loss = out.get(r[0], (0, "", ""))
        out[r[0]] = (n + 1, turns + f"{r[2] or ''}\n{r[3] or ''}\n", loss + ((r[3] or "") if r[2] == "assistant" else ""))
    return {k: (n, hashlib.sha256(a.encode()).hexdigest(), len(b), hashlib.sha256(b.encode()).hexdigest()) for k, (n, a, b) in out.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, loss string")


@pytest.mark.parametrize("part", [1, 40, 1 << 18])
def test_conversations_come_back(spark, part):
    rows = [(1, i, ["user", "assistant"][i % 2], x) for i, x in enumerate(ODD)]
    rows += [(2, 0, "tool\n|<|\\", "a"), (2, 0, None, None), (2, None, "assistant", "b"), (None, 1, "assistant", "c"), (3, 1, "user", "d"), (3, 1, "user", "d")]
    rows += [(4, i, "assistant", "long " * 50) for i in range(300)]
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(frame(spark, rows), part_chars=part)).collect()}
    assert got == slow(rows)


def test_no_conversations_but_the_probe(spark):
    none = frame(spark, []).select("conv_id", "turn", "role", "text")
    assert chat.format_conversations(none).count() == 0
    r = chat.read_back(chat.format_conversations(chat.with_probe(none))).first()
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-1, 2, len("<|im_end|><|im_start|>assistant ok"))
