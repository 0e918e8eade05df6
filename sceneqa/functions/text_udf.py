"""Text edits that depend on a map, on position or on earlier edits: vectorised Python functions over Arrow batches.

Each is guarded by a native test first, so rows that hold nothing to edit never reach Python's regular expressions twice.
"""

from __future__ import annotations

import ast
import json
import math
import operator
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

EDIT = StructType([StructField("text", StringType()), StructField("n", IntegerType())])

#: References with a bracket, lists of references, and the single ones that are left, in the order of their edits (fixed values).
_BRACKET, _MANY, _ONE = (re.compile(p) for p in (r"OBJ\s*(\d+)\s*\([^)]*\)", r"OBJs\s+((?:\d+\s*(?:,\s*)?)+)", r"OBJ\s+(\d+)"))
_BOX = re.compile(r"bbox\[(\d+),(\d+),(\d+),(\d+)\]")


def expand_text(text: str | None, names: dict[str, str]) -> str | None:
    """References to objects become their descriptions, a bracket behind a single one goes; unknown single ones stay.

    Of a list of references the unknown ones vanish if one is known. Without names a text stays as it is; else runs of blanks
    become one.
    """
    if text is None or not names:
        return text

    def one(m: re.Match) -> str:
        return names.get(str(int(m[1])), m[0])

    def many(m: re.Match) -> str:
        known = [names[i] for i in (str(int(d)) for d in re.findall(r"\d+", m[1])) if i in names]
        return ", ".join(known) + " " if known else m[0]

    text = _ONE.sub(one, _MANY.sub(many, _BRACKET.sub(one, text)))
    return re.sub(r"\s{2,}", " ", text).strip()


@pandas_udf(StringType())
def expand_references(text: pd.Series, names: pd.Series) -> pd.Series:
    """names: JSON of object number to description."""
    return pd.Series([expand_text(t, json.loads(n) if n else {}) for t, n in zip(text, names, strict=True)])


def rescale_text(text: str | None, factor: float) -> tuple[str | None, int]:
    if text is None:
        return None, 0
    return _BOX.subn(lambda m: "bbox[" + ",".join(str(round(int(v) * factor)) for v in m.groups()) + "]", text)


@pandas_udf(EDIT)
def rescale_boxes(text: pd.Series, factor: pd.Series) -> pd.DataFrame:
    """Every box in a text times a factor, and how many there were."""
    rows = [rescale_text(t, f) for t, f in zip(text, factor, strict=True)]
    return pd.DataFrame(rows, columns=["text", "n"])


#: An object with its view and box (fixed value).
_SEEN = re.compile(r"(\w[\w_]*)\s*\(Image\s+(\d+)\s*\([^)]*\)\s*bbox\[(\d+),(\d+),(\d+),(\d+)\]\)")
#: Metres a second below which an object stands still (fixed value).
STILL = 0.1
#: What texts say of moving objects and should say if they stand still, in the order of the edits (fixed values).
TO_STILL = {
    "actively riding": "stationary",
    "actively moving": "stationary",
    "actively driving": "stationary",
    "in motion": "stationary",
    "is moving": "is stationary",
    "are moving": "are stationary",
    "is riding": "is stopped",
    "is driving": "is stopped",
    "is traveling": "is stopped",
    "is approaching": "is stationary near",
    "appears to be moving": "appears to be stationary",
    "appears to be driving": "appears to be parked",
    "also in motion": "also stationary",
    "and in motion": "and stationary",
}
#: The opposite, for objects that move (fixed values).
TO_MOTION = {
    "pulled over": "in motion on the road",
    "is parked": "is moving",
    "are parked": "are moving",
    "is stopped": "is moving",
    "is stationary": "is moving",
    "are stationary": "are moving",
    "is stalled": "is moving",
    "is idle": "is moving",
    "is waiting": "is moving",
    "at rest": "in motion",
    "standing still": "moving",
    "not moving": "in motion",
    "appears parked": "appears to be moving",
    "appears stopped": "appears to be moving",
}
_EDITS = {still: [(re.compile(re.escape(old), re.I), new) for old, new in table.items()] for still, table in ((True, TO_STILL), (False, TO_MOTION))}


def correct_text(text: str | None, speeds: dict[str, float], reach: int = 150) -> tuple[str | None, int]:
    """Around each object of known speed what belies it is replaced; the number of phrases replaced.

    Objects are taken from the last to the first, as edits shift what stands behind them; their places are those of the
    text as it came. speeds: by `view,x1,y1,x2,y2`.
    """
    if text is None:
        return None, 0
    changed = 0
    for m in reversed(list(_SEEN.finditer(text))):
        speed = speeds.get(",".join(str(int(v)) for v in m.groups()[1:]))
        if speed is None:
            continue
        lo, hi = max(0, m.start() - reach), min(len(text), m.end() + reach)
        part = text[lo:hi]
        for old, new in _EDITS[speed < STILL]:
            part, n = old.subn(new, part)
            changed += n > 0
        text = text[:lo] + part + text[hi:]
    return text, changed


@pandas_udf(EDIT)
def correct_motion(text: pd.Series, speeds: pd.Series) -> pd.DataFrame:
    """speeds: JSON of `view,x1,y1,x2,y2` to metres a second."""
    rows = [correct_text(t, json.loads(s) if s else {}) for t, s in zip(text, speeds, strict=True)]
    return pd.DataFrame(rows, columns=["text", "n"])


def balanced(text: str, opening: str) -> str | None:
    """The first part of a text from an opening bracket to the one that closes it; brackets in JSON strings don't count."""
    closing = {"{": "}", "[": "]"}[opening]
    start = text.find(opening)
    while start >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                escaped, quoted = c == "\\" and not escaped, c != '"' or escaped
            elif c == '"':
                quoted = True
            elif c == opening:
                depth += 1
            elif c == closing:
                depth -= 1
                if not depth:
                    return text[start : i + 1]
        start = text.find(opening, start + 1)
    return None


def ladder(response: str | None) -> str | None:
    """JSON text in a model's response: all of it, a fenced block, the first whole object, the first whole array."""
    if response is None:
        return None
    body = response.rpartition("</think>")[2].strip()
    fence = re.search(r"```(?:json)?\s*(.*?)```", body, re.S)
    for rung in (lambda: body, lambda: fence and fence[1], lambda: balanced(body, "{"), lambda: balanced(body, "[")):
        candidate = (rung() or "").strip()
        if candidate:
            try:
                json.loads(candidate)
            except ValueError:
                continue
            return candidate
    return None


@pandas_udf(StringType())
def response_json(response: pd.Series) -> pd.Series:
    return pd.Series([ladder(r) for r in response], dtype=object)


def parse_response(response: Column) -> Column:
    """VARIANT of a response: natively where the whole text parses, else by the ladder."""
    whole = F.try_parse_json(response)
    return F.coalesce(whole, F.try_parse_json(response_json(F.when(whole.isNull(), response))))


def role_masks(ids: list[int], start: int, end: int, answer: list[int], quote: int) -> list[int]:
    """0 for plain tokens, 1 inside boxes (between start and end tokens), 2 in the answer (behind its landmark, to a quote)."""
    out, box, reply = [], False, False
    for i, t in enumerate(ids):
        if t == end:
            box = False
        if reply and t == quote:
            reply = False
        out.append(1 if box else 2 if reply else 0)
        if t == start:
            box = True
        if ids[max(0, i + 1 - len(answer)) : i + 1] == answer:
            reply = True
    return out


def token_roles(start: int, end: int, answer: list[int], quote: int):
    """A Column function: token ids to roles."""

    @pandas_udf(ArrayType(IntegerType()))
    def roles(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else role_masks(list(x), start, end, answer, quote) for x in ids])

    return roles


_SIGNS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv, ast.USub: operator.neg, ast.UAdd: operator.pos}
_CALLS = {"sqrt": math.sqrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "log": math.log10, "ln": math.log, "exp": math.exp, "abs": abs}
#: LaTeX and how Python writes it, in order.
_LATEX = [
    (r"\\left|\\right|\\!|\\,|\\;|\\ |\$|\^\s*\{?\\circ\}?|\\%", ""), (r"\\text\s*\{[^{}]*\}", ""), (r"\\[dt]frac", r"\\frac"), (r"\\frac\s*(\d)\s*(\d)", r"((\1)/(\2))"),
    (r"\\(?:cdot|times)", "*"), (r"\\div", "/"), (r"\\pi|π", "(pi)"), (r"\\(sin|cos|tan|log|ln|exp)", r"\1"), (r"−", "-"),
]


@lru_cache(1 << 14)  # a worker keeps the values of its last texts: answers repeat, over batches too
def number(text: str | None) -> float | None:
    """The value of an arithmetic expression, in Python's or LaTeX's notation; null if it is none, or too large. Nothing else is evaluated."""
    if text is None or len(text) > 500:
        return None
    for pattern, new in _LATEX:
        text = re.sub(pattern, new, text)
    before = None
    while before != text:  # from the inside out
        before = text
        text = re.sub(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"((\1)/(\2))", text)
        text = re.sub(r"\\sqrt\s*\[([^][]*)\]\s*\{([^{}]*)\}", r"((\2)**(1/(\1)))", text)
        text = re.sub(r"\\sqrt\s*(?:\{([^{}]*)\}|(\d))", lambda m: f"sqrt({m[1] or m[2]})", text)
        text = re.sub(r"\^\s*\{([^{}]*)\}", r"**(\1)", text)
    text = text.replace("^", "**").replace("{", "(").replace("}", ")")
    text = re.sub(r"(?<=[\d)])\s*(?=\(|[a-z])", "*", re.sub(r"(?<=\d),(?=\d{3}\b)", "", text))

    def of(node: ast.AST) -> float:
        match node:
            case ast.Expression(body=body):
                return of(body)
            case ast.Constant(value=int() | float()):
                return node.value
            case ast.Name(id="pi"):
                return math.pi
            case ast.Name(id="e"):
                return math.e
            case ast.UnaryOp(op=op, operand=x) if type(op) in _SIGNS:
                return _SIGNS[type(op)](of(x))
            case ast.BinOp(left=x, op=ast.Pow(), right=y):
                return float(of(x)) ** float(of(y))
            case ast.BinOp(left=x, op=op, right=y) if type(op) in _SIGNS:
                return _SIGNS[type(op)](of(x), of(y))
            case ast.Call(func=ast.Name(id=name), args=[x], keywords=[]) if name in _CALLS:
                return _CALLS[name](of(x))
        raise ValueError("not arithmetic")

    try:
        value = of(ast.parse(text.strip(), mode="eval"))
        return float(value) if not isinstance(value, complex) and math.isfinite(value) else None
    except (SyntaxError, ValueError, ArithmeticError, TypeError, RecursionError, MemoryError):
        return None


@pandas_udf(DoubleType())
def math_value(text: pd.Series) -> pd.Series:
    return pd.Series([number(t) for t in text], dtype="float64")
