"""Chat formatting: a small sandboxed template language compiled to Python closures.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes closures that write (string, in_loss) chunks.
`{% generation %}` marks what the loss covers. Expressions are literals, names, keys of records, whitelisted filters and operators:
there are no calls, no attributes of Python objects and no names that begin with an underscore.

Conversations are rendered as a stream of rows sorted by (conversation, turn), one turn in memory at a time, so a conversation of any
number of turns needs no more memory than its longest text. The digests are read back from the rendered output by `Reader`.

Escaping: inside roles and texts every `<`, backslashes, `|` gains one backslash, so `<|` occurs in control strings alone; reading takes
one away. In roles a line end is written as `\\n` and a backslash doubled first.

Defined cases: null text or role is empty; turns sort by turn (null first), then role, then text, so ties and repeated rows have one
order and stay separate turns; rows of a null conv_id form one conversation; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for m in messages %}{{ '<|im_' ~ 'start|>' }}{{ m.role | escape_role }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(shown: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(shown), flags=re.S)


FILTERS: dict[str, Callable] = {
    "escape": escape, "escape_role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len,
}


class TemplateError(ValueError):
    """The template is not valid in this language."""


# --- syntax tree: tuples whose first item names the node -------------------------------------------------------------------

TAG = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{-?\s*(.*?)\s*-?\}\}|\{#.*?#\}", re.S)
TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>~+|.()\[\]]))")
ESCAPES = {"n": "\n", "t": "\t"}
LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("~", "+"))


def parse_expression(source: str) -> tuple:
    tokens, at = [], 0
    source = source.strip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        at = m.end()
        if m[1]:
            tokens.append(("lit", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), m[1][1:-1], flags=re.S)))
        elif m[2]:
            tokens.append(("lit", int(m[2])))
        else:
            tokens.append(("name", m[3]) if m[3] else ("op", m[4]))
    tokens.append(("end", ""))
    pos = 0

    def take(*wanted: str) -> str | None:
        nonlocal pos
        kind, value = tokens[pos]
        if kind in ("op", "name") and value in wanted:
            pos += 1
            return value
        return None

    def name() -> str:
        nonlocal pos
        kind, value = tokens[pos]
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"a plain name is needed, not {value!r}")
        pos += 1
        return value

    def primary() -> tuple:
        nonlocal pos
        kind, value = tokens[pos]
        if take("("):
            node = level(0)
            if not take(")"):
                raise TemplateError("missing )")
        elif kind == "lit":
            pos += 1
            node = ("lit", value)
        elif value in ("true", "false", "none"):
            pos += 1
            node = ("lit", {"true": True, "false": False, "none": None}[value])
        else:
            node = ("name", name())
        while op := take(".", "[", "|"):
            if op == ".":
                node = ("key", node, ("lit", name()))
            elif op == "[":
                node = ("key", node, level(0))
                if not take("]"):
                    raise TemplateError("missing ]")
            else:
                f = name()
                if f not in FILTERS:
                    raise TemplateError(f"unknown filter {f}")
                node = ("filter", f, node)
        return node

    def level(k: int) -> tuple:
        if k == len(LEVELS):
            return ("not", primary()) if take("not") else primary()
        node = level(k + 1)
        while op := take(*LEVELS[k]):
            node = ("op", op, node, level(k + 1))
        return node

    tree = level(0)
    if tokens[pos][0] != "end":
        raise TemplateError(f"unexpected {tokens[pos][1]!r}")
    return tree


def parse(source: str) -> tuple:
    """Template text -> ("block", nodes)."""
    stack: list[tuple] = [("block", [])]                           # open constructs; the last item of each collects nodes

    def add(node: tuple) -> None:
        stack[-1][-1].append(node)

    at = 0
    for m in TAG.finditer(source):
        if m.start() > at:
            add(("text", source[at:m.start()]))
        at = m.end()
        if m[2] is not None:
            add(("print", parse_expression(m[2])))
        if m[1] is None:
            continue
        word, _, rest = m[1].partition(" ")
        if word == "for":
            f = re.fullmatch(r"([A-Za-z]\w*) in (.+)", rest.strip(), re.S)
            if not f:
                raise TemplateError(f"bad loop {rest!r}")
            stack.append(("for", f[1], parse_expression(f[2]), []))
        elif word == "if":
            stack.append(("if", [], parse_expression(rest), []))
        elif word in ("elif", "else"):
            kind, done, test, body = stack.pop()
            if kind != "if" or test is None:
                raise TemplateError(f"{word} without if")
            done.append((test, ("block", body)))
            stack.append(("if", done, parse_expression(rest) if word == "elif" else None, []))
        elif word == "generation":
            stack.append(("generation", []))
        elif word in ("endfor", "endif", "endgeneration"):
            node = stack.pop()
            if node[0] != word[3:]:
                raise TemplateError(f"{word} closes {node[0]}")
            body = ("block", node[-1])
            if node[0] == "for":
                add(("for", node[1], node[2], body))
            elif node[0] == "if":
                add(("if", node[1] + ([(node[2], body)] if node[2] is not None else [(("lit", True), body)])))
            else:
                add(("generation", body))
        else:
            raise TemplateError(f"unknown tag {word}")
    if at < len(source):
        add(("text", source[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return stack[0]


OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: shown(a) + shown(b),
}


def shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node: tuple) -> tuple:
    """The same tree with constant expressions, branches and neighbouring strings computed once."""
    kind = node[0]
    if kind == "block":
        out: list[tuple] = []
        for child in map(fold, node[1]):
            for n in child[1] if child[0] == "block" else [child]:
                if n[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + n[1])
                elif n != ("text", ""):
                    out.append(n)
        return ("block", out)
    if kind == "print":
        inner = fold(node[1])
        return ("text", shown(inner[1])) if inner[0] == "lit" else ("print", inner)
    if kind == "filter":
        inner = fold(node[2])
        return ("lit", FILTERS[node[1]](inner[1])) if inner[0] == "lit" else ("filter", node[1], inner)
    if kind == "not":
        inner = fold(node[1])
        return ("lit", not inner[1]) if inner[0] == "lit" else ("not", inner)
    if kind == "op":
        a, b = fold(node[2]), fold(node[3])
        if node[1] in ("and", "or"):
            if a[0] == "lit":
                return b if bool(a[1]) == (node[1] == "and") else a
        elif a[0] == b[0] == "lit":
            return ("lit", OPERATIONS[node[1]](a[1], b[1]))
        return ("op", node[1], a, b)
    if kind == "key":
        return ("key", fold(node[1]), fold(node[2]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "if":
        branches = []
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "lit" and not test[1]:
                continue
            branches.append((test, fold(body)))
            if test[0] == "lit":
                break
        if not branches:
            return ("block", [])
        return branches[0][1] if branches[0][0][0] == "lit" else ("if", branches)
    return node


# --- closures ---------------------------------------------------------------------------------------------------------------

def value_of(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "lit":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n)
    if kind == "key":
        record, key = value_of(node[1]), value_of(node[2])

        def look(scope):
            r = record(scope)
            return r.get(key(scope)) if isinstance(r, dict) else None
        return look
    if kind == "filter":
        f, inner = FILTERS[node[1]], value_of(node[2])
        return lambda scope: f(inner(scope))
    if kind == "not":
        inner = value_of(node[1])
        return lambda scope: not inner(scope)
    a, b = value_of(node[2]), value_of(node[3])
    if node[1] == "and":
        return lambda scope: a(scope) and b(scope)
    if node[1] == "or":
        return lambda scope: a(scope) or b(scope)
    op = OPERATIONS[node[1]]
    return lambda scope: op(a(scope), b(scope))


Chunks = Iterator[tuple[str, bool]]


def writer_of(node: tuple, loss: bool = False) -> Callable[[dict], Chunks]:
    kind = node[0]
    if kind == "text":
        return lambda scope, chunk=(node[1], loss): iter((chunk,))
    if kind == "print":
        value = value_of(node[1])
        return lambda scope: iter(((shown(value(scope)), loss),))
    if kind == "generation":
        return writer_of(node[1], True)
    if kind == "block":
        parts = [writer_of(n, loss) for n in node[1]]

        def block(scope):
            for p in parts:
                yield from p(scope)
        return block
    if kind == "if":
        branches = [(value_of(test), writer_of(body, loss)) for test, body in node[1]]

        def branch(scope):
            for test, body in branches:
                if test(scope):
                    yield from body(scope)
                    return
        return branch
    variable, items, body = node[1], value_of(node[2]), writer_of(node[3], loss)

    def loop(scope):
        for k, item in enumerate(items(scope) or ()):
            yield from body({**scope, variable: item, "loop": {"index0": k, "index": k + 1, "first": k == 0}})
    return loop


def compile_template(source: str) -> Callable[[Iterable[dict]], Chunks]:
    """A function from messages (records with role and text, any iterable) to chunks of output."""
    write = writer_of(fold(parse(source)))
    return lambda messages: write({"messages": messages})


class Reader:
    """Reads turns back from chunks of output as they come, and sums up what a training run would see."""

    def __init__(self):
        self.held: list[tuple[str, bool]] = []
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def feed(self, chunk: tuple[str, bool]) -> None:
        text, loss = chunk
        self.chars += len(text)
        while text:
            # an escaped text holds no control string, so a turn ends at the first one
            head, end, text = (text, "", "") if loss else text.partition(CLOSE + "\n")
            self.held.append((head, loss))
            if end:
                self.close()

    def close(self) -> None:
        whole = "".join(t for t, _ in self.held)
        head, _, text = whole.partition("\n")
        if not head.startswith(OPEN):
            raise ValueError("the output has no turn here")
        role = unescape_role(head[len(OPEN):])
        self.n_turns += 1
        self.turns.update(f"{role}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
        learned = unescape("".join(t for t, loss in self.held if loss))
        self.loss_chars += len(learned)
        self.loss.update(learned.encode("utf-8", "surrogatepass"))
        self.held = []

    def row(self) -> tuple:
        if self.held:
            raise ValueError("the last turn is not closed")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("formatted", T.StringType()),
                     T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.LongType())))])
DIGEST = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                       T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
                       T.StructField("formatted_chars", T.LongType())])


def by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Runs of rows with one conv_id, each a stream of messages."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def messages():
            nonlocal row
            while row is not None and row[0] == key:
                yield {"role": row[1] or "", "text": row[2] or ""}
                row = next(rows, None)

        turns = messages()
        yield key, turns
        for _ in turns:
            pass


def sorted_turns(conversations: DataFrame) -> DataFrame:
    return (conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"))


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, part_chars: int = 1_000_000) -> DataFrame:
    """Rendered output in parts of about `part_chars`, in order: (conv_id, seq, formatted, loss_spans); spans are [start, end) in a part."""
    schema = to_arrow_schema(TURN)

    def run(batches):
        render = compile_template(template)
        for key, turns in by_conversation(batches):
            seq, text, size, spans = 0, [], 0, []
            for chunk, loss in render(turns):
                if loss and chunk:
                    spans.append([size, size + len(chunk)])
                text.append(chunk)
                size += len(chunk)
                if size >= part_chars and chunk.endswith("\n"):
                    yield pa.RecordBatch.from_pylist([{"conv_id": key, "seq": seq, "formatted": "".join(text), "loss_spans": spans}], schema=schema)
                    seq, text, size, spans = seq + 1, [], 0, []
            yield pa.RecordBatch.from_pylist([{"conv_id": key, "seq": seq, "formatted": "".join(text), "loss_spans": spans}], schema=schema)

    return sorted_turns(conversations).mapInArrow(run, TURN)


def format_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation, read back from its rendered output while it is written."""
    schema = to_arrow_schema(DIGEST)

    def run(batches):
        render = compile_template(template)
        rows = []
        for key, turns in by_conversation(batches):
            reader = Reader()
            for chunk in render(turns):
                reader.feed(chunk)
            rows.append((key, *reader.row()))
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return sorted_turns(conversations).mapInArrow(run, DIGEST)
