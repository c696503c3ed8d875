"""The factor language: parsing, static types, statistics and hashes.

Python's grammar is the surface syntax; nothing is executed.  A value is an ARRAY (a trailing window of rows)
or a SCALAR (one number a row).  An ARRAY at the root means its last element.
"""

from __future__ import annotations

import ast
import hashlib
from collections import Counter
from dataclasses import dataclass

ARRAY, SCALAR, INT = "ARRAY", "SCALAR", "INT"
FIELDS = ("open", "high", "low", "close", "volume")

#: Each operator's argument kinds and its result.
SIGNATURES: dict[str, tuple[tuple[str, ...], str]] = {
    **{f: ((INT,), ARRAY) for f in (*FIELDS, "returns")},
    "vwap": ((INT,), SCALAR),
    **{f: ((ARRAY,), ARRAY) for f in ("diff", "log_arr", "normalize")},
    "ema_arr": ((ARRAY, INT), SCALAR),
    "slice_arr": ((ARRAY, INT), ARRAY),
    **{f: ((ARRAY, ARRAY), ARRAY) for f in ("add_arr", "sub_arr", "mul_arr", "div_arr")},
    **{f: ((ARRAY,), SCALAR) for f in ("ts_mean", "ts_std", "ts_max", "ts_min", "ts_sum", "ts_skew", "ts_kurt", "last", "first")},
    "corr": ((ARRAY, ARRAY), SCALAR),
    "cov": ((ARRAY, ARRAY), SCALAR),
    "zscore": ((SCALAR, ARRAY), SCALAR),
    "rank": ((SCALAR, ARRAY), SCALAR),
    **{f: ((SCALAR,), SCALAR) for f in ("neg", "abs_s", "log_s", "tanh_s", "sign_s")},
    **{f: ((SCALAR, SCALAR), SCALAR) for f in ("add", "sub", "mul", "div")},
}
INFIX = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div"}
SYMBOLS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}


class ExprError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """op: an operator name, ``const``, or ``infix_add`` and so on; value: of a constant."""

    op: str
    kind: str
    args: tuple[Node, ...] = ()
    value: float | int | None = None

    def key(self) -> str:
        """Canonical S-expression."""
        return repr(self.value) if self.op == "const" else f"({' '.join([self.op, *(a.key() for a in self.args)])})"


def _build(node: ast.expr) -> Node:
    if isinstance(node, ast.Constant):
        if isinstance(node.value, bool) or not isinstance(node.value, int | float):
            raise ExprError(f"not a number: {node.value!r}")
        return Node("const", SCALAR, (), node.value)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        inner = _build(node.operand)
        return Node("const", SCALAR, (), -inner.value) if inner.op == "const" else Node("neg", SCALAR, (inner,))
    if isinstance(node, ast.BinOp) and type(node.op) in INFIX:
        a, b = _build(node.left), _build(node.right)
        return Node(f"infix_{INFIX[type(node.op)]}", ARRAY if ARRAY in (a.kind, b.kind) else SCALAR, (a, b))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        name = node.func.id
        if name not in SIGNATURES:
            raise ExprError(f"unknown operator: {name}")
        kinds, result = SIGNATURES[name]
        if node.keywords or len(node.args) != len(kinds):
            raise ExprError(f"{name} takes {len(kinds)} positional arguments")
        args = tuple(_build(a) for a in node.args)
        for i, (a, want) in enumerate(zip(args, kinds, strict=True)):
            if want == INT:
                if a.op != "const" or not isinstance(a.value, int) or a.value < 1:
                    raise ExprError(f"{name}: argument {i + 1} must be a whole number of at least 1")
            elif a.kind != want:
                raise ExprError(f"{name}: argument {i + 1} must be {want}, is {a.kind}")
        return Node(name, result, args)
    raise ExprError(f"not allowed here: {type(node).__name__}")


def parse(text: str) -> Node:
    return _build(_tree(text))


def lookback(node: Node) -> int:
    """Rows before the current one that the value can depend on."""
    if node.op == "const":
        return 0
    if node.op in SIGNATURES and SIGNATURES[node.op][0] == (INT,):
        return node.args[0].value - 1 + (node.op == "returns")
    return max((lookback(a) for a in node.args), default=0)


def _tree(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExprError(f"syntax: {e.msg}") from e


def shape(node: ast.AST, number=repr) -> str:
    """S-expression of any expression, known or not; the same under every version of Python.

    Calls are headed by their name, infix operators and the minus sign by their symbol, what else the grammar
    allows by its kind in angle brackets.
    """
    match node:
        case ast.Constant(value=v):
            return number(v)
        case ast.Name(id=name):
            return name
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
            parts = [name, *args]
        case ast.BinOp(op=op, left=a, right=b) if type(op) in SYMBOLS:
            parts = [SYMBOLS[type(op)], a, b]
        case ast.UnaryOp(op=ast.USub(), operand=a):
            parts = ["-", a]
        case _:
            parts = [f"<{type(node).__name__}>", *(x for x in ast.iter_child_nodes(node) if not isinstance(x, ast.expr_context))]
    return f"({' '.join(x if isinstance(x, str) else shape(x, number) for x in parts)})"


def _extent(node: ast.AST) -> tuple[int, int]:
    """(nodes, depth) of a syntax tree, operators and contexts counted."""
    inner = [_extent(x) for x in ast.iter_child_nodes(node)]
    return 1 + sum(n for n, _ in inner), 1 + max([d for _, d in inner], default=0)


@dataclass(frozen=True)
class Form:
    """An expression by its S-expression, before its types are looked at; what else is asked of it follows from that."""

    text: str
    size: tuple[int, int]  # nodes and depth of the syntax tree, the root counted

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()[:16]

    def heads(self) -> Counter[str]:
        """Uses of each operator: calls by name, infix by symbol."""
        return Counter(part.split(" ", 1)[0].rstrip(")") for part in self.text.split("(")[1:])

    def strangers(self) -> list[str]:
        """Names that are called and that the language does not have."""
        return sorted(h for h in self.heads() if h.isidentifier() and h not in SIGNATURES)


def form(text: str) -> Form:
    """The form of a text; ExprError if it is not an expression."""
    tree = _tree(text)
    nodes, depth = _extent(tree)
    return Form(shape(tree), (nodes + 1, depth + 1))


def exact_hash(text: str) -> str:
    return hashlib.sha1(" ".join(text.split()).encode()).hexdigest()[:16]


def profile_hash(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()[:12]


#: Upper ends of the constant buckets of the structural family.
BUCKETS = (5, 20, 60, 120, 240)


def _size_class(v) -> str:
    whole = isinstance(v, int | float) and not isinstance(v, bool)
    return f"c{sum(abs(v) > top for top in BUCKETS)}" if whole else repr(v)


def family_hash(text: str) -> str:
    """Hash of the S-expression with numbers replaced by their size class; texts that do not parse hash as themselves."""
    try:
        form = shape(_tree(text), _size_class)
    except ExprError:
        form = f"invalid:{' '.join(text.split())}"
    return hashlib.sha1(form.encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Verdict:
    """What a static check found: no reasons if the expression is valid, no form if it is not an expression."""

    reasons: list[str]
    form: Form | None = None

    @property
    def valid(self) -> bool:
        return not self.reasons


#: The texts of reasons that other programs read.
_STRANGERS, _DEEP, _LARGE, _UNTYPED = "unknown_ops={}", "depth>{}", "nodes>{}", "compile_error={}"


def validate(text: str, max_depth: int = 18, max_nodes: int = 120, max_lookback: int | None = None) -> Verdict:
    """Static checks of a candidate: syntax, operators, size, types; a lookback limit only if given."""
    try:
        found = form(text)
    except ExprError as e:
        return Verdict([str(e)])
    nodes, depth = found.size
    names = found.strangers()
    checks = [(names, _STRANGERS.format(",".join(names))), (depth > max_depth, _DEEP.format(max_depth)), (nodes > max_nodes, _LARGE.format(max_nodes))]
    try:
        back = lookback(parse(text))
        checks.append((max_lookback is not None and back > max_lookback, f"lookback>{max_lookback}"))
    except ExprError as e:
        checks.append((True, _UNTYPED.format(e)))
    return Verdict([why for failed, why in checks if failed], found)
