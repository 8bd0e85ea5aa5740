"""Text cleaning as JVM-side expressions; nothing here calls Python per row.

Every function takes a SQL expression, usually a column name, and gives a Column.  The
``sql_*`` forms give SQL text, so nested steps reach the JVM as one expression.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import contract as C

# The code points Python's str.isspace() accepts, as a Java character class.
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
BOM = "\ufeff"
# Already clean and without unusual characters: printable ASCII or Latin letters, words
# split by single spaces.  Nearly every cell matches, and the class is cheap to test.
_PLAIN = r"^(?:[!-~\xa1-\u024f]++(?: [!-~\xa1-\u024f]++)*+)?+\z"
_CASED = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"
_WORD_START = f"(?<!{_CASED})(?={_CASED})"
_HANGUL_FIRST, _HANGUL_LAST = "\uac00", "\ud7a3"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(maxsize=1)
def _unicode_tables() -> tuple[str, str, str, str]:
    """Accent tables, derived from the Unicode database rather than listed.

    Characters with one base and their bases, the marks to delete, a SQL map of
    the characters with several bases, and a regex class of those.
    """
    one_to_one, one_to_many, marks = {}, {}, []
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
            continue
        base = "".join(
            x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        if base != ch:
            (one_to_one if len(base) == 1 else one_to_many)[ch] = base
    table = "map(" + ", ".join(quoted(s) for pair in one_to_many.items() for s in pair) + ")"
    # translate deletes characters without a counterpart, here the marks.
    return (quoted("".join(one_to_one) + "".join(marks)), quoted("".join(one_to_one.values())),
            table, "[" + "".join(one_to_many) + f"{_HANGUL_FIRST}-{_HANGUL_LAST}]")


@lru_cache(maxsize=1)
def _digit_table() -> tuple[str, str]:
    digits = [chr(cp) for cp in range(0x80, 0x110000) if unicodedata.category(chr(cp)) == "Nd"]
    return quoted("".join(digits)), quoted("".join(str(unicodedata.decimal(d)) for d in digits))


def outlined(x: str, step: str) -> str:
    """``step``, an expression over ``v``, on ``x`` but kept out of the generated code.

    Rare branches written inline make the generated method too long for the JIT, which
    slows the common path several times over.
    """
    return f"element_at(transform(array({x}), v -> {step}), 1)"


def sql_clean_cell(c: str) -> str:
    x = f"coalesce({c}, '')"
    squeeze = f"trim(regexp_replace(replace(v, '{BOM}', ''), {quoted(WHITESPACE)}, ' '))"
    return f"CASE WHEN {x} RLIKE {quoted(_PLAIN)} THEN {x} ELSE {outlined(x, squeeze)} END"


def clean_cell(c: str) -> Column:
    """Null becomes '', the BOM goes, whitespace is trimmed and squeezed."""
    return F.expr(sql_clean_cell(c))


def _cleaned(c: str, cleaned: bool) -> str:
    return c if cleaned else sql_clean_cell(c)


def _non_ascii(x: str) -> str:
    return f"octet_length({x}) > length({x})"


def _jamo(first: int, index: str, count: int) -> str:
    letters = "".join(chr(first + i) for i in range(count))
    return f"substring('{letters}', cast({index} + 1 AS int), 1)"


def sql_strip_accents(x: str) -> str:
    accented, plain_letters, table, special = _unicode_tables()
    s = f"(ascii(ch) - {ord(_HANGUL_FIRST)})"
    syllable = (
        f"concat({_jamo(0x1100, f'{s} div 588', 19)}, {_jamo(0x1161, f'{s} % 588 div 28', 21)}, "
        f"CASE WHEN {s} % 28 > 0 THEN {_jamo(0x11A8, f'{s} % 28 - 1', 27)} ELSE '' END)")
    walked = (
        f"array_join(transform(regexp_extract_all(v, '(?s).', 0), ch -> CASE WHEN ch BETWEEN "
        f"'{_HANGUL_FIRST}' AND '{_HANGUL_LAST}' THEN {syllable} "
        f"ELSE coalesce(try_element_at({table}, ch), ch) END), '')")
    plain = (f"translate(CASE WHEN v RLIKE {quoted(special)} THEN {walked} ELSE v END, "
             f"{accented}, {plain_letters})")
    return f"CASE WHEN {_non_ascii(x)} THEN {outlined(x, plain)} ELSE {x} END"


def strip_accents(c: str) -> Column:
    """Canonical decomposition without non-spacing marks.

    ASCII text takes none of it, most other text one translate; only text with
    letters that decompose into several bases is walked character by character.
    """
    return F.expr(sql_strip_accents(c))


def normalize_ascii(c: str, *, cleaned: bool = False) -> Column:
    return F.expr(sql_strip_accents(_cleaned(c, cleaned)))


def sql_slugify(c: str, *, cleaned: bool = False) -> str:
    plain = sql_strip_accents(_cleaned(c, cleaned))
    slug = f"trim(BOTH '_' FROM regexp_replace(lower({plain}), '[^a-z0-9]+', '_'))"
    return f"coalesce(nullif({slug}, ''), '{C.NO_SLUG}')"


def slugify(c: str, *, cleaned: bool = False) -> Column:
    return F.expr(sql_slugify(c, cleaned=cleaned))


def category_key(c: str, *, cleaned: bool = False) -> Column:
    key = f"upper({sql_strip_accents(_cleaned(c, cleaned))})"
    for spelling, standard in C.CATEGORY_SPELLINGS:
        key = f"replace({key}, '{spelling}', '{standard}')"
    # Dropping marks can leave spaces at the ends or next to each other.
    key = f"trim(regexp_replace({key}, ' {{2,}}', ' '))"
    return F.expr(f"trim(regexp_replace({key}, {quoted(C.CATEGORY_SUFFIX + chr(92) + 'z')}, ''))")


def _capital(x: str) -> str:
    """Title case of the first character; initcap is slow, so it is left to non-ASCII."""
    first = f"left({x}, 1)"
    return f"CASE WHEN {_non_ascii(first)} THEN initcap({first}) ELSE upper({first}) END"


def sentence_case(c: str) -> Column:
    return F.expr(f"concat({_capital(f'lower({c})')}, substr(lower({c}), 2))")


def sql_is_upper(x: str) -> str:
    return (rf"({x} RLIKE r'\p{{IsUppercase}}' AND "
            rf"NOT {x} RLIKE r'[\p{{IsLowercase}}\p{{Lt}}]')")


def is_upper(c: str) -> Column:
    return F.expr(sql_is_upper(c))


def has_lower(c: str) -> Column:
    return F.expr(rf"{c} RLIKE r'\p{{IsLowercase}}'")


def sql_title_case(x: str) -> str:
    # The rest is lowered behind a letter, as a sigma's form depends on what precedes it.
    word = f"concat({_capital('w')}, substr(lower(concat('a', substr(w, 2))), 2))"
    return f"array_join(transform(split({x}, {quoted(_WORD_START)}), w -> {word}), '')"


def title_case(c: str) -> Column:
    """Capital after every non-letter, so O'Higgins and 2Nd, unlike initcap."""
    return F.expr(sql_title_case(c))


def display_person_name(c: str, *, cleaned: bool = False) -> Column:
    """Title case if all upper, particles in lower case."""
    name = f"CASE WHEN {sql_is_upper('v')} THEN {sql_title_case('v')} ELSE v END"
    for particle in C.NAME_PARTICLES:
        name = f"replace({name}, '{particle}', '{particle.lower()}')"
    return F.expr(outlined(_cleaned(c, cleaned), name))


def full_name(*parts: str) -> Column:
    """Non-empty parts, each trimmed, joined by one space."""
    edges = quoted(f"^{WHITESPACE}|{WHITESPACE}\\z")
    # letters of ASCII at both ends need no trimming
    bare = " AND ".join(f"substr({{p}}, {at}, 1) BETWEEN '!' AND '~'" for at in (1, -1))
    kept = [f"CASE WHEN {bare.format(p=p)} THEN {p} WHEN {p} <> '' THEN regexp_replace({p}, {edges}, '') END"
            for p in parts]
    return F.expr(f"concat_ws(' ', {', '.join(kept)})")


def parse_amount(c: str, *, cleaned: bool = False) -> Column:
    """Whole numbers only; anything else, or beyond a bigint, is null."""
    x = _cleaned(c, cleaned)
    foreign, ascii_digits = _digit_table()
    digits = (f"CASE WHEN {_non_ascii(x)} THEN "
              f"{outlined(x, f'translate(v, {foreign}, {ascii_digits})')} ELSE {x} END")
    return F.expr(
        f"CASE WHEN {x} RLIKE {quoted(C.AMOUNT_PATTERN)} THEN try_cast({digits} AS bigint) END")


def contains_ci(c: str, text: str) -> Column:
    """Case-insensitive contains; % and _ in the text stay wildcards, \\ escapes."""
    pattern, i = [], 0
    while i < len(text):
        ch = text[i]
        following = text[i + 1] if i + 1 < len(text) else "%"
        # A backslash before an ordinary character only means that character.
        if ch == "\\" and following not in "%_\\":
            i += 1
            continue
        step = 2 if ch == "\\" else 1
        pattern.append(text[i:i + step])
        i += step
    return F.col(c).ilike("%" + "".join(pattern) + "%")


def manifest_path(c: str, root: str = "") -> Column:
    """Path as written in manifests: forward slashes, relative to ``root`` if under it."""
    path = rf"regexp_replace(regexp_replace({c}, r'\\', '/'), '^file:/+', '/')"
    path = rf"regexp_replace(regexp_replace({path}, '/{{2,}}', '/'), r'(?<=.)/\z', '')"
    path = rf"regexp_replace(regexp_replace({path}, r'(?<=/)(\./)+', ''), r'^(\./)+', '')"
    if root:
        prefix = root.rstrip("/") + "/"
        path = (f"CASE WHEN startswith({path}, {quoted(prefix)}) "
                f"THEN substr({path}, {len(prefix) + 1}) ELSE {path} END")
    return F.expr(path)
