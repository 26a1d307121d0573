"""Chat formatting with templates compiled to Python closures.

The language: ``{{ expression }}``, ``{% for x in expression %}``,
``{% if %} / {% elif %} / {% else %}``, ``{% set x = expression %}``,
``{% generation %}`` and ``{# comment #}``; a ``-`` inside a delimiter strips
white space on that side. Expressions have string and integer literals,
true, false and none, names, ``a.b`` and ``a['b']`` on mappings, comparisons,
``in``, ``not``, ``and``, ``or``, ``+``, ``~``, conditional expressions
(``a if c else b``) and the filters in ``FILTERS``. There is no attribute
access on Python objects, no call and no import, so a template can only read
what it is given. Loops have ``loop.index0``, ``loop.first`` and
``loop.last``. Texts between generation markers are under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

START, MESSAGE, STOP = "<|start|>", "<|message|>", "<|end|>"
TEMPLATE = "{% for m in messages %}" + START + "{{ m.role | escape }}" + MESSAGE + "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}" + STOP + "\n{% endfor %}"
#: Strings that must not occur in a text as they are: this template's own and those of other chat formats.
CONTROL = [START, MESSAGE, STOP, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
Emit = tuple[str, bool]


class TemplateError(ValueError):
    """A template that can't be parsed, or that reads what isn't there."""


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": escape, "trim": lambda s: s.strip(), "upper": lambda s: s.upper(), "lower": lambda s: s.lower(), "length": len}


# --- Syntax tree -------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    body: tuple
    orelse: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_PARTS = re.compile(r"\{%(-?)(.*?)(-?)%\}|\{\{(-?)(.*?)(-?)\}\}|\{#(-?).*?(-?)#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~|.<>()\[\],=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            if not (m := _TOKEN.match(text, at)):
                raise TemplateError(f"unexpected {text[at:].strip()[:20]!r}")
            self.tokens.append((("int", "str", "name", "op")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("name", "op") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, not {self.peek()[1]!r}")

    def word(self) -> str:
        kind, value = self.peek()
        if kind != "name" or value in _WORDS:
            raise TemplateError(f"a name expected, not {value!r}")
        self.at += 1
        return value

    def whole(self) -> Any:
        out = self.conditional()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def conditional(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.conditional() if self.take("else") else Const("")
            return Op("if", (test, value, other))
        return value

    def either(self) -> Any:
        out = self.both()
        while self.take("or"):
            out = Op("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Op("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        out = self.sum()
        while op := self.take("==", "!=", "<", ">", "<=", ">=", "in", "not"):
            if op == "not":
                self.need("in")
                out = Op("not", (Op("in", (out, self.sum())),))
            else:
                out = Op(op, (out, self.sum()))
        return out

    def sum(self) -> Any:
        out = self.filtered()
        while op := self.take("+", "-", "~"):
            out = Op(op, (out, self.filtered()))
        return out

    def filtered(self) -> Any:
        out = self.access()
        while self.take("|"):
            if (name := self.word()) not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Op("|" + name, (out,))
        return out

    def access(self) -> Any:
        kind, value = self.peek()
        self.at += 1
        if kind == "int":
            out: Any = Const(int(value))
        elif kind == "str":
            out = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        elif kind == "name":
            out = Const(_WORDS[value]) if value in _WORDS else Name(value)
        elif value == "(":
            out = self.conditional()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value or 'end'!r}")
        while op := self.take(".", "["):
            if op == ".":
                out = Item(out, Const(self.word()))
            else:
                out = Item(out, self.conditional())
                self.need("]")
        return out


class _Parser:
    def __init__(self, source: str):
        self.parts: list[tuple[str, str]] = []
        at, strip = 0, False
        for m in _PARTS.finditer(source):
            text = source[at : m.start()]
            text = text.lstrip() if strip else text
            left = m[1] or m[4] or m[7]
            self.parts.append(("text", text.rstrip() if left else text))
            if m[2] is not None:
                self.parts.append(("tag", m[2].strip()))
            elif m[5] is not None:
                self.parts.append(("out", m[5]))
            at, strip = m.end(), bool(m[3] or m[6] or m[8])
        self.parts.append(("text", source[at:].lstrip() if strip else source[at:]))
        self.at = 0

    def body(self, *ends: str) -> tuple[tuple, str]:
        """Nodes up to a tag that begins with one of ``ends``, and that tag."""
        out: list[Any] = []
        while self.at < len(self.parts):
            kind, text = self.parts[self.at]
            self.at += 1
            if kind == "text":
                out += [Output(Const(text))] if text else []
            elif kind == "out":
                out.append(Output(_Expression(text).whole()))
            elif (word := text.split(None, 1)[0] if text else "") in ends:
                return tuple(out), text
            else:
                out.append(self.tag(word, text[len(word) :]))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(out), ""

    def tag(self, word: str, rest: str) -> Any:
        if word == "for":
            e = _Expression(rest)
            name = e.word()
            e.need("in")
            over = e.whole()
            return For(name, over, self.body("endfor")[0])
        if word == "if":
            return self.branch(rest)
        if word == "set":
            e = _Expression(rest)
            name = e.word()
            e.need("=")
            return Assign(name, e.whole())
        if word == "generation" and not rest.strip():
            return Generation(self.body("endgeneration")[0])
        raise TemplateError(f"no tag {word!r}")

    def branch(self, rest: str) -> If:
        test = _Expression(rest).whole()
        body, end = self.body("elif", "else", "endif")
        if end.startswith("elif"):
            return If(test, body, (self.branch(end[4:]),))
        return If(test, body, self.body("endif")[0] if end == "else" else ())


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    return _Parser(source).body()[0]


# --- Constant folding and code generation ------------------------------------

_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "~": lambda a, b: _shown(a) + _shown(b),
}


def _shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node: Any) -> Any:
    """The tree with constant expressions worked out, dead branches gone and adjacent texts joined."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Output) and isinstance(y.value, Const):
                    y = Output(Const(_shown(y.value.value)))
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        y = Output(Const(out.pop().value.value + y.value.value))
                    if not y.value.value:
                        continue
                out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        node = Op(node.op, tuple(map(fold, node.args)))
        if node.op == "if" and isinstance(node.args[0], Const):
            return node.args[1] if node.args[0].value else node.args[2]
        if all(isinstance(a, Const) for a in node.args):
            try:
                return Const(evaluator(node)({}))
            except (TypeError, ValueError, AttributeError):
                return node  # it fails where it is rendered
        return node
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        test, body, orelse = fold(node.test), fold(node.body), fold(node.orelse)
        return (body if test.value else orelse) if isinstance(test, Const) else If(test, body, orelse)
    return node


def evaluator(node: Any) -> Callable[[dict], Any]:
    """A closure that works an expression out in an environment."""
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name

        def read(env: dict) -> Any:
            if name not in env:
                raise TemplateError(f"no {name!r}")
            return env[name]

        return read
    if isinstance(node, Item):
        of, key = evaluator(node.of), evaluator(node.key)

        def item(env: dict) -> Any:
            own = of(env)
            if not isinstance(own, (dict, list, tuple, str)):
                raise TemplateError("only mappings, lists and strings have items")
            try:
                return own[key(env)]
            except (KeyError, IndexError, TypeError) as e:
                raise TemplateError(f"no item {e}") from e

        return item
    args = tuple(map(evaluator, node.args))
    if node.op == "not":
        return lambda env: not args[0](env)
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    if node.op == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    if node.op[0] == "|":
        apply = FILTERS[node.op[1:]]
        return lambda env: apply(args[0](env))
    binary = _BINARY[node.op]
    return lambda env: binary(args[0](env), args[1](env))


Renderer = Callable[[dict, bool], Iterator[Emit]]


def _sequence(nodes: tuple) -> Renderer:
    parts = tuple(map(_renderer, nodes))

    def run(env: dict, masked: bool) -> Iterator[Emit]:
        for part in parts:
            yield from part(env, masked)

    return run


def _renderer(node: Any) -> Renderer:
    if isinstance(node, Output):
        value = evaluator(node.value)

        def show(env: dict, masked: bool) -> Iterator[Emit]:
            yield _shown(value(env)), masked

        return show
    if isinstance(node, Assign):
        value = evaluator(node.value)

        def assign(env: dict, masked: bool) -> Iterator[Emit]:
            env[node.name] = value(env)
            return iter(())

        return assign
    if isinstance(node, Generation):
        body = _sequence(node.body)
        return lambda env, masked: body(env, True)
    if isinstance(node, If):
        test, body, orelse = evaluator(node.test), _sequence(node.body), _sequence(node.orelse)
        return lambda env, masked: (body if test(env) else orelse)(env, masked)
    over, body = evaluator(node.over), _sequence(node.body)

    def loop(env: dict, masked: bool) -> Iterator[Emit]:
        rows = iter(over(env))
        end = object()
        now, k = next(rows, end), 0
        while now is not end:
            after = next(rows, end)
            yield from body({**env, node.name: now, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": after is end}}, masked)
            now, k = after, k + 1

    return loop


class Template:
    """A compiled template; ``render`` gives (text, under the loss mask) one after the other.

    Messages may be an iterator: rendering reads one ahead and holds no more,
    so a conversation of any length is formatted in constant memory.
    """

    def __init__(self, source: str = TEMPLATE):
        self.source = source
        self.tree = fold(parse(source))
        self._run = _sequence(self.tree)

    def render(self, messages: Iterable[dict], **names: Any) -> Iterator[Emit]:
        return self._run({**names, "messages": messages}, False)

    def __reduce__(self):
        return Template, (self.source,)


# --- On tables ---------------------------------------------------------------


def format_conversations(turns: DataFrame, template: str = TEMPLATE, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, at, part, masked)``: each conversation's formatted text in parts.

    The parts of a conversation, in the order of ``at`` (the code points
    before), make up its text; ``masked`` parts count for the loss. Parts of
    a conversation are next to each other in a partition and in order.
    Turns are sorted by number, then role, then text; null roles and texts
    are empty, a null number comes first, and rows with a null conversation
    are one conversation. Equal rows are separate turns.

    A text follows from all turns before it, so a conversation is rendered
    in one task, but as a stream: neither its turns nor its text are ever
    held together. An empty table gives no rows; other columns aren't used,
    whatever their names.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    own = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    compiled = Template(template)
    schema = pa.schema([("conv_id", to_arrow_type(turns.schema[conv_col].dataType)), ("at", pa.int64()), ("part", pa.string()), ("masked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for x in batches for r in zip(*(c.to_pylist() for c in x.columns), strict=True))
        out: list[tuple] = []
        held = 0
        for conv, messages in _conversations(rows):
            at = 0
            for text, masked in compiled.render(messages):
                if text:
                    out.append((conv, at, text, masked))
                    at += len(text)
                    held += len(text)
                    if held > 1 << 22:
                        yield _batch(out, schema)
                        out, held = [], 0
            for _ in messages:  # a template needn't read all
                pass
        yield _batch(out, schema)

    return dealt.mapInArrow(run, f"conv_id {kind}, at long, part string, masked boolean")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[Any, Iterator[dict]]]:
    """Each conversation with its messages, which are read before the next."""
    ahead = next(rows, None)

    def messages(conv: Any) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            now, ahead = ahead, next(rows, None)
            yield {"role": now[1], "text": now[2]}

    while ahead is not None:
        conv = ahead[0]
        yield conv, messages(conv)


class Reader:
    """Reads formatted text back, part by part: its turns and what is under the mask.

    It splits at the markers of ``TEMPLATE``, which no text holds, and
    unescapes what stands between; a message may be spread over any parts.
    """

    def __init__(self):
        self.n_turns = self.chars = self.loss_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.buffer, self.masked = "", ""

    def read(self, part: str, masked: bool) -> None:
        self.chars += len(part)
        if masked:
            self.masked += part
        elif self.masked:
            self._end_mask()
        self.buffer += part
        while (end := self.buffer.find(STOP + "\n")) >= 0:
            head, found, text = self.buffer[:end].partition(MESSAGE)
            if not found or not head.startswith(START):
                raise ValueError("not this template's text")
            self.n_turns += 1
            self.turns.update(f"{unescape(head[len(START) :])}\n{unescape(text)}\n".encode())
            self.buffer = self.buffer[end + len(STOP) + 1 :]

    def _end_mask(self) -> None:
        own = unescape(self.masked)
        self.loss_chars += len(own)
        self.loss.update(own.encode())
        self.masked = ""

    def end(self) -> tuple[int, str, int, str, int]:
        """Turns, their digest, characters and digest under the mask, characters."""
        if self.masked:
            self._end_mask()
        if self.buffer:
            raise ValueError("the text ends within a turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(parts: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from what ``format_conversations`` gives.

    It goes on in the tasks that hold the parts, as a stream.
    """
    kind = parts.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, conv = None, None
        for x in batches:
            out: list[tuple] = []
            for c, at, part, masked in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if at == 0:
                    out += [(conv, *reader.end())] if reader else []
                    reader, conv = Reader(), c
                reader.read(part, masked)
            yield _batch(out, schema)
        yield _batch([(conv, *reader.end())] if reader else [], schema)

    return parts.select("conv_id", "at", "part", "masked").mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(t) - length(replace(t, '\', '')) + len(regexp_extract_all(replace(t, '\', '\\'), '%s')) AS more
      FROM (SELECT *, role || text AS t FROM c))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(t) + more + %d)::bigint AS formatted_chars
FROM e GROUP BY conv_id
""" % ("|".join(re.sub(r"([\[\]|<>/])", r"\\\1", c) for c in CONTROL), len(START + MESSAGE + STOP) + 1)
