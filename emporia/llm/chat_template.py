"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}                       the value as text
    {% for name in expression %} ... {% endfor %}   with loop.index, loop.index0, loop.first, loop.last
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set name = expression %}            visible to the end of the body that holds it
    {% generation %} ... {% endgeneration %}        what is rendered here was generated by the model
    {# comment #}                          {%- -%} and the like strip white space at their side

Expressions: strings, whole numbers, true, false, none, names, ``a.b`` and
``a[b]`` (keys of mappings and places of lists only), ``not``, ``and``, ``or``,
``== != < <= > >= in``, ``+ - * // %``, ``~`` (joins texts), ``a if b else c``,
``is defined``, and filters ``a | name`` from the table the compiler is given.

A template cannot reach Python: there are no calls, no attributes of objects,
no imports, and loops run over lists only.  A missing name or key is undefined,
which renders as nothing and is false.

Compilation: source -> tokens -> syntax tree (tuples) -> the same tree with
constants folded -> closures ``f(scope, out)``.  ``Template.streams`` tells
whether the conversation is only read by one outer loop over ``messages``;
then ``stream`` renders it turn by turn without holding it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping


class TemplateError(ValueError):
    """The template, or what it does with its values, is wrong."""


class _Undefined:
    def __bool__(self):
        return False

    def __repr__(self):
        return "undefined"


UNDEFINED = _Undefined()
PIECES = re.compile(r"(\{\{-?|\{%-?|\{#-?)")
TOKEN = re.compile(r"""\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*%~|.\[\]()<>=]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
CONSTANTS = {"true": True, "false": False, "none": None}
#: Names that open the else or the end of a body.
CLOSERS = {"for": ("endfor",), "if": ("elif", "else", "endif"), "generation": ("endgeneration",)}
#: The longest text that an operator may build.
LONGEST = 1 << 28


def text_of(value) -> str:
    if isinstance(value, str):
        return value
    if value is None or value is UNDEFINED:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} cannot be written")


# -- source to syntax tree


def split_source(source: str) -> Iterator[tuple[str, str]]:
    """(kind, content): text, expression or statement, white space stripped where marks ask for it."""
    at, strip = 0, False
    while at <= len(source):
        opened = PIECES.search(source, at)
        text = source[at:opened.start()] if opened else source[at:]
        if strip:
            text = text.lstrip()
        if opened and opened[0].endswith("-"):
            text = text.rstrip()
        if text:
            yield "text", text
        if not opened:
            return
        end = {"{": "}}", "%": "%}", "#": "#}"}[opened[0][1]]
        stop = end_of(source, opened.end(), end)
        if stop < 0:
            raise TemplateError(f"{opened[0]} is not closed")
        content = source[opened.end():stop]
        strip = content.endswith("-")
        if opened[0][1] != "#":
            yield ("expression" if opened[0][1] == "{" else "statement"), content[:-1] if strip else content
        at = stop + 2


def end_of(source: str, at: int, end: str) -> int:
    """Where ``end`` stands outside quotes."""
    if end == "#}":
        return source.find(end, at)
    quote = ""
    while at < len(source):
        if quote:
            if source[at] == "\\":
                at += 1
            elif source[at] == quote:
                quote = ""
        elif source[at] in "'\"":
            quote = source[at]
        elif source.startswith(end, at):
            return at
        at += 1
    return -1


class Expression:
    """A recursive-descent parser over the tokens of one expression."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.filters, self.tokens, at = filters, [], 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"not understood: {self.tokens[self.at][1]!r}")
        return tree

    def choice(self):
        tree = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else ("const", UNDEFINED)
            return ("choose", test, tree, other)
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        tree = self.joined()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                tree = ("binary", op, tree, self.joined())
            elif self.take("is"):
                flip = bool(self.take("not"))
                self.need("defined")
                tree = ("not", ("defined", tree)) if flip else ("defined", tree)
            else:
                return tree

    def joined(self):
        tree = self.summed()
        while self.take("~"):
            tree = ("binary", "~", tree, self.summed())
        return tree

    def summed(self):
        tree = self.product()
        while op := self.take("+", "-"):
            tree = ("binary", op, tree, self.product())
        return tree

    def product(self):
        tree = self.signed()
        while op := self.take("*", "//", "%"):
            tree = ("binary", op, tree, self.signed())
        return tree

    def signed(self):
        return ("binary", "-", ("const", 0), self.signed()) if self.take("-") else self.reached()

    def reached(self):
        tree = self.atom()
        while True:
            if self.take("."):
                tree = ("item", tree, ("const", self.name()))
            elif self.take("["):
                tree = ("item", tree, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name}")
                tree = ("filter", name, tree)
            else:
                return tree

    def atom(self):
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind == "number":
            return ("const", int(value))
        if kind == "name":
            return ("const", CONSTANTS[value]) if value in CONSTANTS else ("name", value)
        raise TemplateError(f"not understood: {value!r}")


def parse(source: str, filters: Mapping[str, Callable]) -> tuple:
    """The syntax tree of a template: ("body", nodes)."""
    parts = list(split_source(source))
    at = 0

    def body(closers: tuple[str, ...]) -> tuple[tuple, str, str]:
        nonlocal at
        nodes = []
        while at < len(parts):
            kind, content = parts[at]
            at += 1
            if kind == "text":
                nodes.append(("write", ("const", content)))
            elif kind == "expression":
                nodes.append(("write", Expression(content, filters).whole()))
            else:
                word, _, rest = content.strip().partition(" ")
                if word in closers:
                    return ("body", nodes), word, rest
                nodes.append(statement(word, rest))
        if closers:
            raise TemplateError(f"{closers[-1]} is missing")
        return ("body", nodes), "", ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for":
            e = Expression(rest, filters)
            name = e.name()
            e.need("in")
            return ("for", name, e.whole(), body(CLOSERS["for"])[0])
        if word == "if":
            test = Expression(rest, filters).whole()
            then, closer, rest = body(CLOSERS["if"])
            if closer == "elif":
                return ("if", test, then, ("body", [statement("if", rest)]))
            return ("if", test, then, body(("endif",))[0] if closer == "else" else ("body", []))
        if word == "set":
            e = Expression(rest, filters)
            name = e.name()
            e.need("=")
            return ("set", name, e.whole())
        if word == "generation":
            return ("generation", body(CLOSERS["generation"])[0])
        raise TemplateError(f"no statement {word!r}")

    return body(())[0]


# -- folding


def binary(op: str, a, b):
    """A binary operator on values; texts and whole numbers only."""
    if op in ("==", "!="):
        return (a == b and type(a) is type(b)) == (op == "==")
    if op == "~":
        return text_of(a) + text_of(b)
    if op == "in":
        if isinstance(b, str) and isinstance(a, str) or isinstance(b, (list, Mapping)):
            return a in b
        raise TemplateError("'in' needs a text, list or mapping")
    numbers = all(isinstance(x, int) and not isinstance(x, bool) for x in (a, b))
    texts = isinstance(a, str) and isinstance(b, str)
    if op == "+" and (numbers or texts):
        return a + b
    if op in ("<", "<=", ">", ">=") and (numbers or texts):
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if numbers and op in ("-", "*"):
        out = a - b if op == "-" else a * b
        if abs(out) > LONGEST:
            raise TemplateError("a number is too large")
        return out
    if numbers and op in ("//", "%"):
        if not b:
            raise TemplateError("division by zero")
        return a // b if op == "//" else a % b
    raise TemplateError(f"{op} does not fit its values")


def fold(tree: tuple, filters: Mapping[str, Callable]) -> tuple:
    """The tree with constant expressions worked out, decided branches chosen and neighbouring texts joined."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "body":
        nodes = []
        for node in (fold(n, filters) for n in tree[1]):
            inner = node[1] if node[0] == "body" else [node]  # a decided branch
            for n in inner:
                if n[0] == "write" and n[1][0] == "const":
                    text = text_of(n[1][1])
                    if not text:
                        continue
                    if nodes and nodes[-1][0] == "write" and nodes[-1][1][0] == "const":
                        text = nodes.pop()[1][1] + text
                    n = ("write", ("const", text))
                nodes.append(n)
        return ("body", nodes)
    parts = tuple(fold(p, filters) if isinstance(p, tuple) else p for p in tree[1:])
    tree = (kind, *parts)

    def constant(p):
        return p[0] == "const"

    try:
        if kind == "binary" and constant(parts[1]) and constant(parts[2]):
            return ("const", binary(parts[0], parts[1][1], parts[2][1]))
        if kind == "not" and constant(parts[0]):
            return ("const", not parts[0][1])
        if kind in ("and", "or") and constant(parts[0]):
            return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
        if kind == "choose" and constant(parts[0]):
            return parts[1] if parts[0][1] else parts[2]
        if kind == "filter" and constant(parts[1]):
            return ("const", filters[parts[0]](parts[1][1]))
        if kind == "defined" and constant(parts[0]):
            return ("const", parts[0][1] is not UNDEFINED)
        # a set of the chosen branch stays inside it, so only branches without one are taken out
        if kind == "if" and constant(parts[0]):
            chosen = parts[1] if parts[0][1] else parts[2]
            if not any(n[0] == "set" for n in chosen[1]):
                return chosen
    except TemplateError:
        pass  # wrong only if it is reached
    return tree


# -- closures


class Output:
    """Rendered pieces, their length in code points, and the spans that were generated."""

    __slots__ = ("parts", "size", "spans")

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def value_of(tree: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    """A closure for an expression."""
    kind = tree[0]
    if kind == "const":
        held = tree[1]
        return lambda scope: held
    if kind == "name":
        key = tree[1]
        return lambda scope: scope.get(key, UNDEFINED)
    if kind == "item":
        of, at = value_of(tree[1], filters), value_of(tree[2], filters)

        def item(scope):
            whole, key = of(scope), at(scope)
            if isinstance(whole, Mapping):
                return whole.get(key, UNDEFINED)
            if isinstance(whole, list) and isinstance(key, int) and not isinstance(key, bool):
                return whole[key] if -len(whole) <= key < len(whole) else UNDEFINED
            return UNDEFINED

        return item
    if kind == "filter":
        change, of = filters[tree[1]], value_of(tree[2], filters)
        return lambda scope: change(of(scope))
    if kind == "not":
        of = value_of(tree[1], filters)
        return lambda scope: not of(scope)
    if kind == "defined":
        of = value_of(tree[1], filters)
        return lambda scope: of(scope) is not UNDEFINED
    if kind == "choose":
        test, yes, no = (value_of(t, filters) for t in tree[1:])
        return lambda scope: yes(scope) if test(scope) else no(scope)
    if kind == "binary":
        op, left, right = tree[1], value_of(tree[2], filters), value_of(tree[3], filters)
        return lambda scope: binary(op, left(scope), right(scope))
    left, right = value_of(tree[1], filters), value_of(tree[2], filters)
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    return lambda scope: left(scope) or right(scope)


def action_of(tree: tuple, filters: Mapping[str, Callable]) -> Callable[[dict, Output], None]:
    """A closure for a statement."""
    kind = tree[0]
    if kind == "body":
        steps = [action_of(n, filters) for n in tree[1]]
        sets = any(n[0] == "set" for n in tree[1])

        def body(scope, out):
            scope = dict(scope) if sets else scope
            for step in steps:
                step(scope, out)

        return steps[0] if len(steps) == 1 and not sets else body
    if kind == "write":
        if tree[1][0] == "const":
            text = text_of(tree[1][1])
            return lambda scope, out: out.write(text)
        of = value_of(tree[1], filters)
        return lambda scope, out: out.write(text_of(of(scope)))
    if kind == "set":
        key, of = tree[1], value_of(tree[2], filters)

        def assign(scope, out):
            scope[key] = of(scope)

        return assign
    if kind == "if":
        test, yes, no = value_of(tree[1], filters), action_of(tree[2], filters), action_of(tree[3], filters)
        return lambda scope, out: yes(scope, out) if test(scope) else no(scope, out)
    if kind == "generation":
        inner = action_of(tree[1], filters)

        def generation(scope, out):
            start = out.size
            inner(scope, out)
            out.spans.append((start, out.size))

        return generation
    key, of, inner = tree[1], value_of(tree[2], filters), action_of(tree[3], filters)

    def loop(scope, out):
        values = of(scope)
        if values is UNDEFINED or values is None:
            return
        if not isinstance(values, list):
            raise TemplateError("for needs a list")
        for i, v in enumerate(values):
            inner({**scope, key: v, "loop": place(i, i + 1 == len(values))}, out)

    return loop


def place(i: int, last: bool) -> dict:
    return {"index": i + 1, "index0": i, "first": i == 0, "last": last}


def names_in(tree) -> set[str]:
    """The names that a tree reads."""
    if isinstance(tree, tuple) and tree and tree[0] == "name":
        return {tree[1]}
    if isinstance(tree, (tuple, list)):
        return set().union(*(names_in(t) for t in tree)) if tree else set()
    return set()


FILTERS: dict[str, Callable] = {
    "trim": lambda v: text_of(v).strip(), "upper": lambda v: text_of(v).upper(), "lower": lambda v: text_of(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, Mapping)) else 0, "string": text_of,
}


class Template:
    """A compiled template; ``filters`` are added to the built-in ones."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        known = {**FILTERS, **(filters or {})}
        self.tree = fold(parse(source, known), known)
        self._render = action_of(self.tree, known)
        # One outer loop over messages whose other parts do not read them: turns can be rendered one by one.
        nodes = self.tree[1]
        loops = [i for i, n in enumerate(nodes) if n[0] == "for" and n[2] == ("name", "messages")]
        self.streams = (len(loops) == 1 and not any(n[0] == "set" for n in nodes)
                        and all("messages" not in names_in(n if i != loops[0] else n[3]) for i, n in enumerate(nodes)))
        if self.streams:
            at = loops[0]
            self._name = nodes[at][1]
            self._before, self._turn, self._after = (action_of(t, known) for t in (("body", nodes[:at]), nodes[at][3], ("body", nodes[at + 1:])))

    def render(self, messages: list[Mapping], **more) -> tuple[str, list[tuple[int, int]]]:
        """The text of a conversation and its generated spans (code points)."""
        out = Output()
        self._render({"messages": messages, **more}, out)
        return "".join(out.parts), out.spans

    def turn(self, message: Mapping, index0: int, last: bool, out: Output, **more) -> None:
        """Write one turn of a conversation: what comes before the loop with the first, what comes behind it with the last."""
        if not self.streams:
            raise TemplateError("the template reads the whole conversation")
        if index0 == 0:
            self._before(more, out)
        self._turn({**more, self._name: message, "loop": place(index0, last)}, out)
        if last:
            self._after(more, out)

    def stream(self, messages: Iterable[Mapping], **more) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """(text, spans inside it) of one turn after the other; together they are the rendered conversation."""
        ahead = iter(messages)
        now = next(ahead, None)
        if now is None:
            out = Output()
            self._before(more, out)
            self._after(more, out)
            yield "".join(out.parts), out.spans
        i = 0
        while now is not None:
            following = next(ahead, None)
            out = Output()
            self.turn(now, i, following is None, out, **more)
            yield "".join(out.parts), out.spans
            now, i = following, i + 1
