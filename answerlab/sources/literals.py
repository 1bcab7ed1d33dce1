"""Lists of texts written as Python literals, read with built-in expressions.

One pattern tells whether a text is a whole list, another one cuts it into items. Both read strings with their
escapes, so a quote, bracket or comma inside a string never counts. All loops are possessive: they neither
go back nor recurse, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from answerlab.functions import text

# Fixed values of the notation: blanks between items, escapes, letters of escapes.
_BLANK = r"(?:[ \t\f\r\n]|\\\r?\n|#[^\r\n\x00]*+)*+"
_ESCAPE = (
    r"\\(?:\r\n|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:0010|000[0-9a-fA-F])[0-9a-fA-F]{4}|N\{[^{}'\"\\\r\n]++\}"
    r"|[^xuUN\x00])"
)
_LETTERS = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", "'": "'", '"': '"'}


def _string(escape: str) -> str:
    """A string of either kind of quotes, single or tripled, with these escapes."""
    kinds = []
    for quote in "'\"":
        # Plain letters are taken by runs: a step of the loop for every letter costs several times as much.
        kinds.append(rf"{quote * 3}(?:[^{quote}\\\x00]++|{escape}|{quote}(?!{quote * 2}))*+{quote * 3}")
        kinds.append(rf"{quote}(?!{quote * 2})(?:[^{quote}\\\r\n\x00]++|{escape})*+{quote}")
    return f"(?:{'|'.join(kinds)})"


_STRING = rf"(?:[uU]?+{_string(_ESCAPE)}|[rR]{_string(r'\\(?:\r\n|[^\x00])')})"
_NUMBER = (
    r"[+-]?+(?:(?:[0-9](?:_?[0-9])*+)?+\.[0-9](?:_?[0-9])*+(?:[eE][+-]?+[0-9](?:_?[0-9])*+)?+"
    r"|[0-9](?:_?[0-9])*+\.(?:[eE][+-]?+[0-9](?:_?[0-9])*+)?+"
    r"|[0-9](?:_?[0-9])*+[eE][+-]?+[0-9](?:_?[0-9])*+"
    r"|0(?:_?0)*+|[1-9](?:_?[0-9])*+)(?![0-9A-Za-z_.])"
)
_NAME = r"(?:None|True|False)(?![0-9A-Za-z_])"
_ITEM = rf"(?:{_STRING}(?:{_BLANK}{_STRING})*+|{_NAME}|{_NUMBER})"
_MORE = rf"(?:{_BLANK},{_BLANK}{_ITEM})*+{_BLANK}"
_LIST = rf"\[{_BLANK}(?:{_ITEM}{_MORE},?+{_BLANK})?+\]"
_TUPLE = rf"\({_BLANK}(?:{_ITEM}{_BLANK},{_BLANK}(?:{_ITEM}{_MORE},?+{_BLANK})?+)?+\)"
_WHOLE = rf"^{_BLANK}(?:{_LIST}|{_TUPLE}){_BLANK}$".replace("$", r"\z")
#: What is left of a text without its strings shows whether it is a list at all, and of what.
_ANY_STRING = rf"{_STRING}|[bB][rR]?{_string(_ESCAPE)}"


def decode_list(serialised: Column, key: Column | None = None) -> Column:
    """A list or tuple of texts written as a Python literal, as ``ARRAY<STRING>``; blank text gives an empty list.

    Strings with the prefixes u and r, tripled quotes, neighbouring strings (which are one) and all escapes are read;
    ``None`` is null; numbers and truth values keep their spelling. ``\\N{...}`` takes the names that Java
    knows and those of Chinese characters. A half of a surrogate pair becomes U+FFFD. Text that is no list
    fails the job with an error that names ``key``; so do nested lists and bytes.
    """
    where = F.concat(F.lit("row "), key.cast("string"), F.lit(": ")) if key is not None else F.lit("")
    shown = F.left(serialised, F.lit(80))

    def fail(why: str) -> Column:
        return F.raise_error(F.concat(where, F.lit(why + ": "), shown)).cast("array<string>")

    bare = F.regexp_replace(serialised, _ANY_STRING, "_")
    items = F.transform(F.regexp_extract_all(serialised, F.lit(_ITEM), F.lit(0)), lambda item: _item(item, where, shown))
    return (
        F.when(text.is_blank(serialised), F.array().cast("array<string>"))
        .when(serialised.rlike(_WHOLE), items)
        .when(bare.rlike(r"(?s)^\s*[\[(].*[\[({].*[\])]\s*\z"), fail("an answer must be text in a list"))
        .when(bare.rlike(r"^\s*[\[(]"), fail("not a valid list"))
        .otherwise(fail("not a list"))
    )


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often it is used; inside a list nothing else sees to that."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _item(written: Column, where: Column, shown: Column) -> Column:
    """The text of one item: its strings one after the other."""
    strings = F.transform(F.regexp_extract_all(written, F.lit(_STRING), F.lit(0)), lambda s: _content(s, where, shown))
    quoted = F.left(written, F.lit(2)).rlike("^[uUrR]?['\"]")
    # Most items are one plain string.
    plain = written.rlike(r"^(?:'(?!'')[^'\\]*+'|\"(?!\"\")[^\"\\]*+\")\z")
    inside = F.substring(written, F.lit(2), F.length(written) - 2)
    return F.when(~quoted, F.nullif(written, F.lit("None"))).when(plain, inside).otherwise(F.array_join(strings, ""))


def _content(written: Column, where: Column, shown: Column) -> Column:
    # A pattern is tried on the first letters only: it would take a copy of the whole string.
    head = F.left(written, F.lit(4))
    prefix = F.when(head.rlike("^[uUrR]"), 1).otherwise(0)
    quotes = F.when(head.rlike("^[uUrR]?(?:'''|\"\"\")"), 3).otherwise(1)
    inside = F.substring(written, prefix + quotes + 1, F.length(written) - prefix - 2 * quotes)

    def joined(inside: Column) -> Column:
        # A line break in a text is one character, however it is written.
        return F.when(F.contains(inside, F.lit("\r")), F.regexp_replace(inside, "\r\n?", "\n")).otherwise(inside)

    def read(inside: Column) -> Column:
        escaped = F.contains(inside, F.lit("\\")) & ~head.rlike("^[rR]")
        return F.when(escaped, _unescaped(inside, where, shown)).otherwise(inside)

    return _bound(_bound(inside, joined), read)


def _unescaped(inside: Column, where: Column, shown: Column) -> Column:
    cut = r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\N\{[^}]++\}|\\[0-7]{1,3}|\\[\s\S]|[^\\]++"

    def letter(hexadecimal: Column) -> Column:
        # With a mark of byte order before it, so that such a mark itself stays.
        return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(hexadecimal, 8, "0"))), "UTF-32")

    def named(part: Column) -> Column:
        name = F.regexp_extract(part, r"\{(.*)\}", 1)
        chinese = F.regexp_extract(name, r"(?i)^CJK UNIFIED IDEOGRAPH-([0-9A-F]{4,5})$", 1)
        known = F.hex(F.try_reflect(F.lit("java.lang.Character"), F.lit("codePointOf"), name).cast("bigint"))
        unknown = F.raise_error(F.concat(where, F.lit("not a valid list, unknown character "), part, F.lit(": "), shown))
        return letter(F.coalesce(F.nullif(chinese, F.lit("")), known, unknown.cast("string")))

    def read(part: Column) -> Column:
        out = F.when(~part.startswith("\\"), part)
        out = out.when(part.rlike(r"^\\[xuU]."), letter(F.substring(part, 3, 8)))
        out = out.when(part.rlike(r"^\\[0-7]"), letter(F.conv(F.substring(part, 2, 3), 8, 16)))
        out = out.when(part.rlike(r"^\\N\{"), named(part))
        out = out.when(part == "\\\n", "")
        for after, meant in _LETTERS.items():
            out = out.when(part == "\\" + after, F.lit(meant))
        return out.otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(inside, F.lit(cut), F.lit(0)), read), "")
