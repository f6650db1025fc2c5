"""A small pre-pass over SQL text for what Spark's parser or defaults lack.

Quantified comparisons become a CASE over one row of the subquery: its count, its
count of values, its least and its greatest value say whether `x op ANY (q)` and
`x op ALL (q)` are true, false or unknown, wherever they stand. Where equality
with any value is asked for, IN does it. ORDER BY keys get NULLS LAST, in either
direction, where they don't say. `LIMIT m, n`, `$1`, `TABLE(f(..))` and block
comments are read, LIKE has no escape character unless one is given, and under
`compat` functions of null and division by zero follow the engine whose
semantics this package offers rather than ANSI.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\$\w+|[A-Za-z_][\w$]*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|<=>|<>|!=|<=|>=|\|\||::|\s+|.", re.S)
COMPARISONS = {"=", "<>", "!=", "<", "<=", ">", ">="}
TIME_TYPE = "spark.sql.timeType.enabled"
ENDS = {"limit", "offset", "union", "except", "intersect", "rows", "range", "fetch"}


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


def closing(parts: list[str], at: int) -> int:
    """The index of the parenthesis that closes the one at `at`."""
    depth = 0
    for i in range(at, len(parts)):
        depth += (parts[i] == "(") - (parts[i] == ")")
        if not depth:
            return i
    raise ValueError("unbalanced parentheses")


def solid(parts: list[str], at: int, step: int) -> int:
    """The next index from `at` that isn't white space or a comment."""
    while 0 <= at < len(parts) and (parts[at].isspace() or parts[at].startswith(("--", "/*"))):
        at += step
    return at


def opening(parts: list[str], at: int) -> int:
    """The index of the parenthesis that the one at `at` closes."""
    depth = 0
    for i in range(at, -1, -1):
        depth += (parts[i] == ")") - (parts[i] == "(")
        if not depth:
            return i
    raise ValueError("unbalanced parentheses")


NOT_FUNCTIONS = {"where", "and", "or", "not", "on", "when", "then", "else", "select", "having", "by", "in", "case", "between", "like", "from", "distinct", "all", "any", "some"}


def primary_start(parts: list[str], end: int) -> int:
    """Where the name, literal, call or parenthesised expression that ends at `end` begins."""
    i = end
    if parts[i] == ")":
        i = opening(parts, i)
        before = solid(parts, i - 1, -1)
        if before >= 0 and re.fullmatch(r"[A-Za-z_]\w*", parts[before]) and parts[before].lower() not in NOT_FUNCTIONS:
            i = before
    while (before := solid(parts, i - 1, -1)) >= 0 and parts[before] == ".":
        i = solid(parts, before - 1, -1)
    return i


def operand_start(parts: list[str], end: int) -> int:
    """Where the operand that ends at `end` begins: a name, literal, call or
    parenthesised expression, with arithmetic around such."""
    i = primary_start(parts, end)
    while (before := solid(parts, i - 1, -1)) >= 0:
        if parts[before] in {"+", "-", "*", "/", "%", "||", "::"}:
            last = solid(parts, before - 1, -1)
            # A sign rather than an operator stands behind another operator, a keyword or nothing.
            if last < 0 or parts[last] in COMPARISONS | {"(", ",", "+", "-", "*", "/", "%"} or parts[last].lower() in NOT_FUNCTIONS:
                return before
            i = primary_start(parts, last)
        else:
            break
    return i


def clause(parts: list[str], at: int) -> str:
    """The keyword that opens the part of the statement that `at` is in; `case` inside a CASE."""
    depth = cases = 0
    for i in range(at, -1, -1):
        word = parts[i].lower()
        depth += (word == ")") - (word == "(")
        if depth > 0:
            continue
        cases += (word == "end") - (word == "case")
        if cases < 0:
            return "case"
        if word in {"select", "where", "having", "on", "set", "by"}:
            return word
    return ""


def quantified(parts: list[str]) -> list[str]:
    at = 0
    while at < len(parts):
        word = parts[at].lower()
        if word in {"any", "some", "all"}:
            op, opened = solid(parts, at - 1, -1), solid(parts, at + 1, 1)
            first = solid(parts, opened + 1, 1) if opened < len(parts) else opened
            if op >= 0 and parts[op] in COMPARISONS and first < len(parts) and parts[opened] == "(" and parts[first].lower() in {"select", "values", "with"}:
                close = closing(parts, opened)
                inner = "".join(quantified(parts[opened + 1 : close]))
                end = solid(parts, op - 1, -1)
                start = operand_start(parts, end)
                before, after = solid(parts, start - 1, -1), solid(parts, close + 1, 1)
                alone = parts[before].lower() in {"where", "and"} and (after >= len(parts) or parts[after].lower() in {"and", "group", "order", "limit", "having", ")", ";"})
                made = comparison("".join(parts[start : end + 1]).strip(), parts[op], word == "all", inner, clause(parts, start), alone)
                parts = [*parts[:start], made, *parts[close + 1 :]]
                at = start
        at += 1
    return parts


def comparison(left: str, op: str, every: bool, inner: str, where: str, alone: bool) -> str:
    """`left op ANY|ALL (inner)`, three-valued. `alone`: one of the conditions of a
    WHERE that must all be true, where a semi join with one row will do for ANY."""
    op = "<>" if op == "!=" else op
    one = f"(select named_struct('n', count(*), 'm', count(__v), 'lo', min(__v), 'hi', max(__v)) from ({inner}) as __q(__v))"
    n, m, lo, hi = (f"{one}.{x}" for x in ("n", "m", "lo", "hi"))
    unknown = f"({left}) is null or {n} > {m}"
    if op in ("=", "<>") and every == (op == "<>"):
        # Some value equals, or none does: IN is a semi join, NOT IN an anti join that knows nulls.
        if where in ("where", "having", "on"):
            return f"(({left}) {'not ' * every}in ({inner}))"
        return f"(case when {n} = 0 then {str(every).lower()} when ({left}) in ({inner}) then {str(not every).lower()} when {unknown} then null else {str(every).lower()} end)"
    if op in ("=", "<>"):
        # All values are one and the same, or not.
        differs = f"({left}) <> {lo} or ({left}) <> {hi}"
        return f"(case when {n} = 0 then {str(every).lower()} when {differs} then {str(not every).lower()} when {unknown} then null else {str(every).lower()} end)"
    # One value decides: the hardest of all, or the easiest of any.
    value = hi if (op[0] == ">") == every else lo
    if alone and where == "where" and not every:
        return f"exists (select 1 from (select {'min' if op[0] == '>' else 'max'}(__v) as __v from ({inner}) as __q(__v)) as __q where ({left}) {op} __q.__v)"
    decided = f"not (({left}) {op} {value})" if every else f"({left}) {op} {value}"
    return f"(case when {n} = 0 then {str(every).lower()} when {decided} then {str(not every).lower()} when {unknown} then null else {str(every).lower()} end)"


def small_forms(parts: list[str]) -> list[str]:
    """`LIMIT m, n`, `$1` and `$name`, `TABLE(f(..))`, LIKE without an escape character."""
    out = list(parts)
    for i, x in enumerate(out):
        word = x.lower()
        if re.fullmatch(r"\$\w+", x):
            out[i] = f":_{x[1:]}" if x[1:].isdigit() else f":{x[1:]}"
        elif word == "limit":
            first = solid(out, i + 1, 1)
            comma = solid(out, first + 1, 1)
            last = solid(out, comma + 1, 1)
            if last < len(out) and out[comma] == ",":
                out[first], out[comma], out[last] = f"{out[last]} offset {out[first]}", "", ""
        elif word == "table":
            before, opened = solid(out, i - 1, -1), solid(out, i + 1, 1)
            if before >= 0 and out[before].lower() in {"from", "join", ","} and opened < len(out) and out[opened] == "(":
                close = closing(out, opened)
                name, inside = solid(out, opened + 1, 1), solid(out, opened + 2, 1)
                if out[inside] == "(" and closing(out, inside) == solid(out, close - 1, -1):
                    out[i] = out[opened] = out[close] = ""
                    if out[name].lower() == "numbers":
                        args = "".join(out[inside + 1 : closing(out, inside)])
                        for k in range(name, close):
                            out[k] = ""
                        out[i] = f"(select cast(id as int) as number from range({args}))"
        elif word in {"like", "ilike"}:
            pattern = solid(out, i + 1, 1)
            after = solid(out, pattern + 1, 1)
            if pattern < len(out) and out[pattern].startswith("'") and (after >= len(out) or out[after].lower() not in {"escape", "||"}):
                # A control character that no pattern has.
                out[pattern] = f"{out[pattern]} escape '{chr(1)}'"
    return out


COMPAT_LENGTHS = {"char_length", "character_length", "octet_length"}


def compat_forms(parts: list[str]) -> list[str]:
    """Lengths and positions of null are 0; x / 0 is infinite, 0 / 0 NaN; SUBSTRING counts bytes and TRIM strips a whole string."""
    out, i = list(parts), 0
    while i < len(out):
        word, opened = out[i].lower(), solid(out, i + 1, 1)
        if word in COMPAT_LENGTHS and opened < len(out) and out[opened] == "(":
            close = closing(out, opened)
            out[i : close + 1] = [f"coalesce({out[i]}({''.join(compat_forms(out[opened + 1 : close]))}), 0)"]
        elif word == "position" and opened < len(out) and out[opened] == "(":
            close = closing(out, opened)
            depth, inner = 0, compat_forms(out[opened + 1 : close])
            for k, x in enumerate(inner):
                depth += (x == "(") - (x == ")")
                if not depth and x.lower() == "in":
                    out[i : close + 1] = [f"position(coalesce({''.join(inner[:k])}, '') in coalesce({''.join(inner[k + 1 :])}, ''))"]
                    break
        elif word in {"substring", "substr", "trim"} and opened < len(out) and out[opened] == "(":
            close = closing(out, opened)
            given = _arguments(compat_forms(out[opened + 1 : close]))
            made = _trimmed(given) if word == "trim" else _substring(given)
            if made:
                out[i : close + 1] = [made]
        elif word == "/":
            start, last = _product_start(out, i), solid(out, i + 1, 1)
            end = last
            while out[end] in {"-", "+"}:
                end = solid(out, end + 1, 1)
            following = solid(out, end + 1, 1)
            while following < len(out) and out[following] in {".", "("}:
                end = closing(out, following) if out[following] == "(" else solid(out, following + 1, 1)
                following = solid(out, end + 1, 1)
            if out[end] == "(":
                end = closing(out, end)
            x = f"cast({''.join(out[start:i]).strip()} as double)"
            y = f"cast({''.join(compat_forms(out[last : end + 1])).strip()} as double)"
            out[start : end + 1] = [f"(case when {y} = 0 then case when {x} > 0 then double('inf') when {x} < 0 then double('-inf') when {x} = 0 then double('nan') end else {x} / nullif({y}, 0) end)"]
            i = start
        i += 1
    return out


def _arguments(inner: list[str]) -> list[tuple[str, str]]:
    """(the comma, FROM or FOR before it, text) of what stands between two parentheses."""
    found, depth = [("", [])], 0
    for x in inner:
        depth += (x == "(") - (x == ")")
        if not depth and x.lower() in {",", "from", "for"}:
            found.append((x.lower(), []))
        elif not x.startswith("--"):
            found[-1][1].append(x)
    return [(before, "".join(x).strip()) for before, x in found]


def _substring(given: list[tuple[str, str]]) -> str | None:
    """SUBSTRING by bytes, as `scalars.substring_compat` has it; a lambda reads each argument once."""
    if len(given) > 3:
        return None
    start, length = "1", "2147483647"
    for place, (before, text) in enumerate(given[1:]):
        if before == "for" or (before == "," and place):
            length = text
        else:
            start = text
    fields = f"named_struct('s', cast(cast({given[0][1]} as string) as binary), 'f', cast({start} as bigint) - 1, 'n', cast({length} as bigint))"
    size = "octet_length(x.s)"
    at = f"case when x.f < 0 then pmod(x.f, {size} + 1) else x.f end"
    taken = f"case when x.n is null then null when x.n between 0 and {size} then cast(x.n as int) else {size} end"
    cut = f"make_valid_utf8(cast(substring(x.s, cast({at} as int) + 1, {taken}) as string))"
    return f"get(transform(array({fields}), x -> case when {at} <= {size} then {cut} end), 0)"


def _trimmed(given: list[tuple[str, str]]) -> str | None:
    """TRIM of repeats of a whole string, as `scalars.trim_compat` has it."""
    if len(given) > 2 or (len(given) == 2 and given[1][0] != "from"):
        return None
    said, value = ("", given[0][1]) if len(given) == 1 else (given[0][1], given[1][1])
    where, what = re.fullmatch(r"(both\b|leading\b|trailing\b|)\s*(.*)", said, re.I | re.S).groups()
    # A null `what` strips nothing.
    unit = r"replace(coalesce(" + (what or "' '") + r", ''), '\\E', '\\E\\\\E\\Q')"
    if where.lower() != "trailing":
        value = rf"regexp_replace({value}, concat('^(?:\\Q', {unit}, '\\E)++'), '')"
    if where.lower() != "leading":
        value = rf"regexp_replace({value}, concat('(?:\\Q', {unit}, '\\E)+\\z'), '')"
    return value


def _product_start(parts: list[str], at: int) -> int:
    """Where the product whose operator stands at `at` begins."""
    i = primary_start(parts, solid(parts, at - 1, -1))
    while (before := solid(parts, i - 1, -1)) >= 0 and parts[before] in {"*", "%"}:
        i = primary_start(parts, solid(parts, before - 1, -1))
    return i


def nulls_last(parts: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(parts):
        out.append(parts[i])
        following = solid(parts, i + 1, 1)
        if parts[i].lower() == "order" and following < len(parts) and parts[following].lower() == "by":
            out += parts[i + 1 : following + 1]
            i = following + 1
            depth, key = 0, []
            while i < len(parts):
                word = parts[i].lower()
                if depth == 0 and (word in {",", ")"} or word in ENDS or word == ";"):
                    out += _with_nulls(key)
                    key = []
                    if word != ",":
                        break
                    out.append(parts[i])
                else:
                    depth += (word == "(") - (word == ")")
                    key.append(parts[i])
                i += 1
            else:
                out += _with_nulls(key)
            continue
        i += 1
    return out


def _with_nulls(key: list[str]) -> list[str]:
    if not "".join(key).strip() or any(x.lower() == "nulls" for x in key):
        return key
    end = len(key)
    while end and key[end - 1].isspace():
        end -= 1
    return [*nulls_last(key[:end]), " nulls last", *key[end:]]


def rewrite(text: str, compat: bool = False) -> str:
    parts = [x for x in tokens(text.strip().rstrip(";")) if not x.startswith("/*")]
    # In a literal, a backslash stands for itself.
    parts = quantified(small_forms([x.replace(chr(92), chr(92) * 2) if x.startswith("'") else x for x in parts]))
    # What was made is one token by now.
    parts = nulls_last(tokens("".join(parts)))
    return "".join(compat_forms(parts) if compat else parts)


def aliases(text: str) -> dict[str, str]:
    """Names that the first select list gives to expressions."""
    parts = tokens(text)
    first = next((i for i, x in enumerate(parts) if x.lower() == "select"), len(parts))
    out, depth, item = {}, 0, []
    for x in [*parts[first + 1 :], "from"]:
        if not depth and (x == "," or x.lower() == "from"):
            said = "".join(item).strip()
            if m := re.fullmatch(r"(?P<e>.*\S)\s+as\s+`?(?P<n>\w+)`?", said, re.I | re.S):
                out[m["n"].lower()] = m["e"]
            item = []
            if x != ",":
                break
            continue
        depth += (x == "(") - (x == ")")
        item.append(x)
    return out


def with_alias(text: str, name: str, expression: str) -> str:
    """`text` with the alias `name` replaced in the WHERE clause of the outermost query."""
    parts, depth, inside = tokens(text), 0, False
    for i, x in enumerate(parts):
        depth += (x == "(") - (x == ")")
        word = x.lower()
        if not depth and word in {"where", "group", "having", "order", "limit", "union", "except", "intersect"}:
            inside = word == "where"
        elif inside and word.strip("`") == name.lower():
            before, after = solid(parts, i - 1, -1), solid(parts, i + 1, 1)
            if parts[before] != "." and (after >= len(parts) or parts[after] not in {"(", "."}):
                parts[i] = f"({expression})"
    return "".join(parts)


def run(spark: SparkSession, text: str, args: dict | None = None, compat: bool = False) -> DataFrame:
    """`text` in this package's dialect. Names of the select list may stand in WHERE, where no column has the name.
    A text with TIME values turns them on in a session that has them off; they stay on, since Spark
    asks again when it makes further plans of the result, a join with itself for one."""
    names, tried = aliases(text), set()
    while True:
        try:
            return spark.sql(rewrite(text, compat), args=args or None)
        except AnalysisException as e:
            if e.getCondition() == "UNSUPPORTED_TIME_TYPE" and spark.conf.get(TIME_TYPE) != "true":
                spark.conf.set(TIME_TYPE, "true")
                continue
            if not (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                raise
            name = (e.getMessageParameters() or {}).get("objectName", "").strip("`").lower()
            if name not in names or name in tried:
                raise
            tried.add(name)
            text = with_alias(text, name, names[name])
