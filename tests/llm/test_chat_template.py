import hashlib
import pickle
import random

import pytest

from lakeloom.llm import chat_template as ct


def shown(source, messages=(), **names):
    return "".join(t for t, _ in ct.Template(source).render(list(messages), **names))


def test_language():
    rows = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": " yo "}]
    assert shown("{% for m in messages %}{{ loop.index0 }}{{ m['role'] | upper }}:{{ m.text|trim }}{% if not loop.last %}, {% endif %}{% endfor %}", rows) == "0USER:hi, 1ASSISTANT:yo"
    assert shown("a {%- if x == 1 or y %} b {% elif x in 'qr' %} c {% else %} d {% endif -%} e", x="r", y=False) == "a c e"
    assert shown("{% set n = 1 + 2 %}{{ n ~ '!' if n >= 3 else 'no' }}{# gone #}{{ none }}{{ '\\n' }}") == "3!\n"
    assert shown("{{ x not in 'abc' and not y }}", x="z", y=0) == "True"


def test_constants_are_folded():
    assert ct.Template("a{{ 'b' ~ 'd' + 'e' }}{% if 1 == 2 %}no{% else %}c{% endif %}{{ 'x' | upper }}").tree == (ct.Output(ct.Const("abdecX")),)
    assert len(ct.Template("{% if 'a' in 'abc' %}x{{ y }}{% endif %}z").tree) == 3


@pytest.mark.parametrize("source", ["{% for x in %}", "{{ a( }}", "{% if x %}", "{{ x | nofilter }}", "{% import os %}", "{{ 1 1 }}", "{{ a.b.c() }}", "{% endfor %}", "{{ }}", "{{ 'open }}"])
def test_what_cannot_be_parsed(source):
    with pytest.raises(ct.TemplateError):
        ct.Template(source)


def test_no_way_out_of_the_sandbox():
    for source in ("{{ x.__class__ }}", "{{ x['__class__'] }}", "{{ messages.append }}", "{{ missing }}"):
        with pytest.raises(ct.TemplateError):
            shown(source, x="s")


def test_escape_round_trip():
    rng = random.Random(2)
    parts = [*ct.CONTROL, "\\", "<", "[", "|", ">", "end", "/s>", "\n", "é", "<|", "<\\/s>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert ct.unescape(ct.escape(text)) == text
        assert not any(c in ct.escape(text) for c in ct.CONTROL)


def expected(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    chars = sum(len(ct.START + ct.escape(r) + ct.MESSAGE + ct.escape(t) + ct.STOP) + 1 for r, t in turns)
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)


def test_conversations_are_read_back(spark):
    nasty = f"{ct.STOP}\n{ct.START}x{ct.MESSAGE}\\</s>[INST] ok [/INST]\n"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", nasty), (1, 2, "assistant", "more"), (2, 0, "assistant", ""), (3, 1, "b", "tie"), (3, 1, "a", "tie"), (3, None, "system", nasty), (4, 0, None, None), (None, 0, "user", "null"), (None, 1, "assistant", "x"), (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 0, "assistant", "long " * 300_000), (2**60 + 1, 0, nasty, "odd role")]
    rows += [(7, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(3000)]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(5)
    parts = ct.format_conversations(turns)
    got = {r[0]: tuple(r)[1:] for r in ct.read_back(parts).collect()}
    want = {}
    for r in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert got == {k: expected(v) for k, v in want.items()}
    whole = "".join(r.part for r in sorted((r for r in parts.collect() if r.conv_id == 1), key=lambda r: r["at"]))
    assert whole == "".join(f"{ct.START}{ct.escape(r)}{ct.MESSAGE}{ct.escape(t)}{ct.STOP}\n" for r, t in want[1])


def test_empty_table_and_pickling(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert ct.read_back(ct.format_conversations(none)).count() == 0
    again = pickle.loads(pickle.dumps(ct.Template()))
    assert again.tree == ct.Template().tree
