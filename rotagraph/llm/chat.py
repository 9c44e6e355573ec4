"""Chat formatting: a compiler for sandboxed templates that mark generated text.

A template is literal text with ``{{ expression }}``, ``{% if %}``, ``{% for %}``,
``{% set %}`` and ``{% generation %} ... {% endgeneration %}``. It is parsed into a syntax
tree, constants are folded, and the tree becomes Python closures; nothing is evaluated as
Python source, names reach only the given variables, attributes only mapping keys, and
calls only the filters listed here. Rendering yields (text, generated) pieces one by one,
so a conversation is formatted turn by turn, however long it is.

Texts are escaped reversibly: the escape sign is put before every sign that could begin a
control string. ``read_back`` parses a formatted conversation into turns again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rotagraph.llm.shared import bounded

Piece = tuple[str, bool]

TEMPLATE = "{% for message in messages %}{{ '<turn ' + message.role | escape + '>' }}{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %}{{ '</turn>' + '\\n' }}{% endfor %}"
ESCAPE, OPENING, CLOSING = "\\", "<turn ", "</turn>\n"
#: Characters of a formatted conversation in one row of the output.
PART = 1 << 20


def escape(text: str) -> str:
    """Puts the escape sign before itself, ``<`` and ``>``."""
    return re.sub(r"[\\<>]", lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(),
    "length": len, "string": str, "default": lambda x, y="": y if x is None else x,
}


class TemplateError(ValueError):
    pass


_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+%|.<>()\[\],=~]))")
_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.DOTALL)
_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    """Recursive descent over one tag's expression. Nodes: ('const', v), ('name', n),
    ('key', node, key), ('op', o, a, b), ('not', a), ('filter', f, a, args)."""

    ORDER = [("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"), ("%",)]

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            n, s, name, sign = m.groups()
            if n is not None:
                self.tokens.append(("const", int(n)))
            elif s is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), s[1:-1], flags=re.DOTALL)))
            else:
                self.tokens.append(("word", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None):
        kind, got = self.peek()
        if value is not None and got != value or kind == "end":
            raise TemplateError(f"expected {value or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def whole(self):
        node = self.level(0)
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def level(self, k: int):
        if k == len(self.ORDER):
            return self.filtered()
        if self.ORDER[k] == ("not",):
            if self.peek() == ("word", "not"):
                self.take()
                return ("not", self.level(k))
            return self.level(k + 1)
        left = self.level(k + 1)
        while self.peek()[0] in ("sign", "word") and self.peek()[1] in self.ORDER[k]:
            op = self.take()
            left = ("op", op, left, self.level(k + 1))
        return left

    def filtered(self):
        node = self.primary()
        while self.peek() == ("sign", "|"):
            self.take()
            name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            args = []
            if self.peek() == ("sign", "("):
                self.take()
                while self.peek() != ("sign", ")"):
                    args.append(self.level(0))
                    if self.peek() == ("sign", ","):
                        self.take()
                self.take(")")
            node = ("filter", name, node, args)
        return node

    def primary(self):
        kind, value = self.peek()
        self.take()
        if kind == "const":
            node = ("const", value)
        elif (kind, value) == ("sign", "("):
            node = self.level(0)
            self.take(")")
        elif kind == "word":
            node = ("const", _CONSTANTS[value]) if value in _CONSTANTS else ("name", value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek() in (("sign", "."), ("sign", "[")):
            if self.take() == ".":
                node = ("key", node, ("const", self.take()))
            else:
                node = ("key", node, self.level(0))
                self.take("]")
        return node


_OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "%": lambda a, b: a % b if isinstance(a, int) else _not_a_number(a), "~": lambda a, b: f"{a}{b}",
}


def _not_a_number(a):
    raise TemplateError(f"% takes numbers, not {a!r}")


def _fold(node):
    """Folds what holds only constants; ``a + ('b' + 'c')`` chains of text join too."""
    kind = node[0]
    if kind == "not":
        a = _fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "op":
        op, a, b = node[1], _fold(node[2]), _fold(node[3])
        if op in ("and", "or") and a[0] == "const":
            return b if bool(a[1]) == (op == "and") else a
        if op in _OPERATIONS and a[0] == b[0] == "const":
            return ("const", _OPERATIONS[op](a[1], b[1]))
        return ("op", op, a, b)
    if kind == "filter":
        a, args = _fold(node[2]), [_fold(x) for x in node[3]]
        if a[0] == "const" and all(x[0] == "const" for x in args):
            return ("const", FILTERS[node[1]](a[1], *[x[1] for x in args]))
        return ("filter", node[1], a, args)
    if kind == "key":
        return ("key", _fold(node[1]), _fold(node[2]))
    return node


def _closure(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda _, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "key":
        a, k = _closure(node[1]), _closure(node[2])

        def key(env):
            x, y = a(env), k(env)
            return x.get(y) if isinstance(x, dict) else x[y] if isinstance(x, (list, str)) and isinstance(y, int) and -len(x) <= y < len(x) else None

        return key
    if kind == "not":
        a = _closure(node[1])
        return lambda env: not a(env)
    if kind == "filter":
        f, a, args = FILTERS[node[1]], _closure(node[2]), [_closure(x) for x in node[3]]
        return lambda env: f(a(env), *[x(env) for x in args])
    a, b = _closure(node[2]), _closure(node[3])
    if node[1] == "and":
        return lambda env: a(env) and b(env)
    if node[1] == "or":
        return lambda env: a(env) or b(env)
    op = _OPERATIONS[node[1]]
    return lambda env: op(a(env), b(env))


def parse(source: str):
    """The syntax tree of a template: a list of ('text', s), ('out', e), ('if', [(e, body)],
    else), ('for', name, e, body), ('set', name, e) and ('generation', body)."""
    stack: list = [("root", [])]
    body, at, strip = stack[0][1], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        left, out, right, left2, tag, right2 = m.groups()
        if left or left2:
            text = text.rstrip()
        if text:
            body.append(("text", text))
        at, strip = m.end(), bool(right or right2)
        if out is not None:
            body.append(("out", _Expression(out).whole()))
        elif tag is not None:
            word, _, rest = tag.strip().partition(" ")
            if word == "for":
                name, found, over = rest.strip().partition(" in ")
                if not found or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError(f"for: {rest!r}")
                stack.append(("for", [], name.strip(), _Expression(over).whole()))
            elif word == "if":
                stack.append(("if", [], [], _Expression(rest).whole()))
            elif word == "elif" and stack[-1][0] == "if" or word == "else" and stack[-1][0] == "if":
                _, now, branches, e = stack.pop()
                stack.append(("if", [], [*branches, (e, now)], _Expression(rest).whole() if word == "elif" else ("const", True)))
            elif word == "generation":
                stack.append(("generation", []))
            elif word == "set":
                name, found, value = rest.partition("=")
                if not found:
                    raise TemplateError(f"set: {rest!r}")
                body.append(("set", name.strip(), _Expression(value).whole()))
            elif word.startswith("end") and len(stack) > 1 and stack[-1][0] == word[3:]:
                kind, now, *more = stack.pop()
                node = ("generation", now) if kind == "generation" else ("for", *more, now) if kind == "for" else ("if", [*more[0], (more[1], now)])
                stack[-1][1].append(node)
            else:
                raise TemplateError(f"unexpected tag {word!r}")
            body = stack[-1][1]
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    text = source[at:].lstrip() if strip else source[at:]
    return [*body, ("text", text)] if text else body


def fold(body: list) -> list:
    """Folds expressions, drops branches that constants rule out and joins literal texts."""
    out: list = []
    for node in body:
        if node[0] == "out":
            e = _fold(node[1])
            new = [("text", "" if e[1] is None else str(e[1]))] if e[0] == "const" else [("out", e)]
        elif node[0] == "if":
            branches = []
            for e, b in node[1]:
                e = _fold(e)
                if e[0] != "const" or e[1]:
                    branches.append((e, fold(b)))
                if e[0] == "const" and e[1]:
                    break
            new = branches[0][1] if branches and branches[0][0][0] == "const" else [("if", branches)] if branches else []
        elif node[0] == "for":
            new = [("for", node[1], _fold(node[2]), fold(node[3]))]
        elif node[0] == "set":
            new = [("set", node[1], _fold(node[2]))]
        elif node[0] == "generation":
            new = [("generation", fold(node[1]))]
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            else:
                out.append(x)
    return out


def _emit(body: list, generated: bool = False) -> Callable[[dict], Iterator[Piece]]:
    steps: list[Callable] = []
    for node in body:
        kind = node[0]
        if kind == "text":
            steps.append(lambda _, p=(node[1], generated): (p,))
        elif kind == "out":

            def out(env, e=_closure(node[1])):
                x = e(env)
                return ((x if isinstance(x, str) else "" if x is None else str(x), generated),)

            steps.append(out)
        elif kind == "set":

            def put(env, n=node[1], e=_closure(node[2])):
                env[n] = e(env)
                return ()

            steps.append(put)
        elif kind == "generation":
            steps.append(_emit(node[1], True))
        elif kind == "if":

            def choose(env, branches=[(_closure(e), _emit(b, generated)) for e, b in node[1]]):
                return next((b(env) for e, b in branches if e(env)), ())

            steps.append(choose)
        else:

            def loop(env, n=node[1], e=_closure(node[2]), inner=_emit(node[3], generated)):
                it = iter(e(env) or ())
                now, k = next(it, it), 0
                while now is not it:  # one turn ahead, so that loop.last is known
                    after = next(it, it)
                    yield from inner(env | {n: now, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": after is it}})
                    now, k = after, k + 1

            steps.append(loop)

    def run(env: dict) -> Iterator[Piece]:
        for s in steps:
            yield from s(env)

    return run


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages (dicts; any iterable, read once) to pieces of text, each
    with its generation mark."""
    run = _emit(fold(parse(source)))
    return lambda messages, **variables: run({"messages": messages, **variables})


class Digest:
    """Reads a formatted conversation back, piece by piece, and keeps digests only."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest, self.masked = "", ""

    def add(self, text: str, mask: list[tuple[int, int]]) -> None:
        """Text of the conversation and the masked ranges of it, in order."""
        self.chars += len(text)
        for a, b in mask:
            raw = self.masked + text[a:b]
            # an escape sign without its partner waits for the next piece
            hold = (len(raw) - len(raw.rstrip(ESCAPE))) % 2
            self.masked = raw[len(raw) - hold :]
            got = unescape(raw[: len(raw) - hold])
            self.loss_chars += len(got)
            self.loss.update(got.encode("utf-8", "surrogatepass"))
        buffer, at = self.rest + text, 0
        while True:
            end = buffer.find(CLOSING, at)  # a closing string never stands inside an escaped text
            if end < 0:
                break
            role, _, said = buffer[at + len(OPENING) : end].partition(">") if "\\" not in buffer[at : buffer.find(">", at)] else _split_head(buffer[at + len(OPENING) : end])
            self.turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
            at = end + len(CLOSING)
        self.rest = buffer[at:]

    def row(self) -> tuple[int, str, int, str, int]:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _split_head(turn: str) -> tuple[str, str, str]:
    """At the first ``>`` that is not escaped."""
    m = re.match(r"((?:\\.|[^\\>])*)>", turn, re.DOTALL)
    return m[1], ">", turn[m.end() :]


PARTS = "conv_id long, part int, text string, mask array<struct<a:int,b:int>>"
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("mask", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def format_conversations(rows: DataFrame, template: str = TEMPLATE, part: int = PART) -> DataFrame:
    """(conv_id, part, text, mask): every conversation formatted, in parts of about ``part``
    characters; ``mask`` has the generated ranges of a part. The parts of a conversation
    are consecutive rows of one partition, in order.

    ``rows``: (conv_id, turn, role, text). Turns are ordered by ``turn``, nulls first, then
    role and text; repeated rows are turns of their own; null roles and texts are empty; a
    null conv_id is one conversation. Only these columns are read. A task streams its
    conversations: a long one is never held whole.
    """
    turns = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        render = compile_template(template)
        stream = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        ahead = next(stream, None)

        def messages(conv):
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield ahead[1]
                ahead = next(stream, None)

        done, weight = [], 0
        while ahead is not None:
            conv = ahead[0]
            texts, mask, size, k = [], [], 0, 0
            for text, generated in render(messages(conv)):
                if generated and text:
                    mask.append({"a": size, "b": size + len(text)}) if not mask or mask[-1]["b"] != size else mask[-1].update(b=size + len(text))
                texts.append(text)
                size += len(text)
                if size >= part:
                    done.append({"conv_id": conv, "part": k, "text": "".join(texts), "mask": mask})
                    weight, texts, mask, size, k = weight + size, [], [], 0, k + 1
                    yield pa.RecordBatch.from_pylist(done, schema=_PARTS)
                    done, weight = [], 0
            if size or not k:
                done.append({"conv_id": conv, "part": k, "text": "".join(texts), "mask": mask})
                weight += size
            for _ in messages(conv):  # a template that leaves turns unread
                pass
            if weight >= part:
                yield pa.RecordBatch.from_pylist(done, schema=_PARTS)
                done, weight = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_PARTS)

    return bounded(turns).mapInArrow(run, PARTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame) -> DataFrame:
    """Digests (DIGESTS) of conversations formatted with TEMPLATE, parsed from their parts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(DIGESTS))

    def run(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for conv, k, text, mask in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k == 0:
                    if digest is not None:
                        out.append((now, *digest.row()))
                    now, digest = conv, Digest()
                digest.add(text, [(m["a"], m["b"]) for m in mask])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip((now, *digest.row()), schema, strict=True)], schema=schema)

    return bounded(parts).mapInArrow(run, DIGESTS)
