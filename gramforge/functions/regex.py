"""Regular expressions of the linear-time dialect (RE2): parsing, validation, literals, translation to Java and Python.

A pattern is parsed once into a small tree (tuples whose first element names the
kind).  Flags are resolved while parsing, so that every node says itself
whether it ignores case:

    ("char", c, fold)      one character
    ("any",)               the dot
    ("class", text, fold)  a character class, in a form that Java and Python's ``regex`` read alike
    ("anchor", name)       begin, end, line_begin, line_end, word, no_word
    ("cat", [nodes]) ("alt", [nodes]) ("group", node) ("repeat", node, least, most)

Whether a repetition is greedy is not kept, as only the existence of a match
matters.  Patterns that the dialect rejects raise :class:`InvalidPattern`; a
rejected pattern matches nothing, and no Spark task ever sees it.

Known differences: ``\\C`` reads one character (the dialect: one byte), and
the category C includes unassigned characters.
"""

from __future__ import annotations

import re
from functools import lru_cache

MOST_REPEATS = 1000

# What the escapes, names and categories stand for.
_EVERYTHING = r"\x00-\U0010ffff"
_CLASSES = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r "}
_NEGATED = {"d": r"\x00-/:-\U0010ffff", "w": r"\x00-/:-@\[-\^`{-\U0010ffff", "s": r"\x00-\x08\x0b\x0e-\x1f!-\U0010ffff"}
_CONTROLS = {"a": "\a", "f": "\f", "t": "\t", "n": "\n", "r": "\r", "v": "\v"}
_ANCHORS = {"A": "begin", "z": "end", "b": "word", "B": "no_word"}
_POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7f", "blank": r"\t ", "cntrl": r"\x00-\x1f\x7f", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0b\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_POSIX_NEGATED = {
    "alnum": r"\x00-/:-@\[-`{-\U0010ffff", "alpha": r"\x00-@\[-`{-\U0010ffff", "ascii": r"\x80-\U0010ffff", "blank": r"\x00-\x08\x0a-\x1f!-\U0010ffff",
    "cntrl": r" -~\x80-\U0010ffff", "digit": r"\x00-/:-\U0010ffff", "graph": r"\x00- \x7f-\U0010ffff", "lower": r"\x00-`{-\U0010ffff", "print": r"\x00-\x1f\x7f-\U0010ffff",
    "punct": r"\x00- 0-9A-Za-z\x7f-\U0010ffff", "space": r"\x00-\x08\x0e-\x1f!-\U0010ffff", "upper": r"\x00-@\[-\U0010ffff", "word": r"\x00-/:-@\[-\^`{-\U0010ffff",
    "xdigit": r"\x00-/:-@G-`g-\U0010ffff",
}
_CATEGORIES = frozenset("C Cc Cf Co Cs L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps S Sc Sk Sm So Z Zl Zp Zs".split())
_SCRIPTS = frozenset(
    """
    Adlam Ahom Anatolian_Hieroglyphs Arabic Armenian Avestan Balinese Bamum Bassa_Vah Batak Bengali Bhaiksuki Bopomofo Brahmi Braille Buginese
    Buhid Canadian_Aboriginal Carian Caucasian_Albanian Chakma Cham Cherokee Chorasmian Common Coptic Cuneiform Cypriot Cyrillic Deseret
    Devanagari Dives_Akuru Dogra Duployan Egyptian_Hieroglyphs Elbasan Elymaic Ethiopic Georgian Glagolitic Gothic Grantha Greek Gujarati
    Gunjala_Gondi Gurmukhi Han Hangul Hanifi_Rohingya Hanunoo Hatran Hebrew Hiragana Imperial_Aramaic Inherited Inscriptional_Pahlavi
    Inscriptional_Parthian Javanese Kaithi Kannada Katakana Kayah_Li Kharoshthi Khitan_Small_Script Khmer Khojki Khudawadi Lao Latin Lepcha
    Limbu Linear_A Linear_B Lisu Lycian Lydian Mahajani Makasar Malayalam Mandaic Manichaean Marchen Masaram_Gondi Medefaidrin Meetei_Mayek
    Mende_Kikakui Meroitic_Cursive Meroitic_Hieroglyphs Miao Modi Mongolian Mro Multani Myanmar Nabataean Nandinagari New_Tai_Lue Newa Nko
    Nushu Nyiakeng_Puachue_Hmong Ogham Ol_Chiki Old_Hungarian Old_Italic Old_North_Arabian Old_Permic Old_Persian Old_Sogdian
    Old_South_Arabian Old_Turkic Oriya Osage Osmanya Pahawh_Hmong Palmyrene Pau_Cin_Hau Phags_Pa Phoenician Psalter_Pahlavi Rejang Runic
    Samaritan Saurashtra Sharada Shavian Siddham SignWriting Sinhala Sogdian Sora_Sompeng Soyombo Sundanese Syloti_Nagri Syriac Tagalog
    Tagbanwa Tai_Le Tai_Tham Tai_Viet Takri Tamil Tangut Telugu Thaana Thai Tibetan Tifinagh Tirhuta Ugaritic Vai Wancho Warang_Citi Yezidi
    Yi Zanabazar_Square
    """.split()
)


class InvalidPattern(ValueError):
    """The dialect has no such pattern."""


def _class_char(c: str) -> str:
    return "\\" + c if c in "[]\\^-&~|" else c if c.isprintable() else f"\\x{ord(c):02x}" if ord(c) < 256 else c


_BOUNDS = re.compile(r"\{([0-9]+)(,([0-9]*))?\}")
_NAME = re.compile(r"P<([A-Za-z_]\w*)>")
_FLAGS = re.compile(r"([imsU]*)(?:-([imsU]+))?([:)])")
_HEX = re.compile(r"\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2})")
_OCTAL = re.compile(r"[0-7]{1,2}")
_PROPERTY = re.compile(r"\{(\^?\w+)\}|(\w)")
_POSIX_NAME = re.compile(r":(\^?)(\w+):\]")


class _Parser:
    def __init__(self, pattern: str) -> None:
        self.p, self.i = pattern, 0
        self.names: set[str] = set()

    def peek(self, n: int = 1) -> str:
        return self.p[self.i : self.i + n]

    def take(self) -> str:
        if self.i >= len(self.p):
            raise InvalidPattern("the pattern ends too soon")
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self, flags: frozenset) -> tuple:
        branches = []
        while True:
            node, flags = self.sequence(flags)
            branches.append(node)
            if self.peek() != "|":
                return branches[0] if len(branches) == 1 else ("alt", branches)
            self.take()

    def sequence(self, flags: frozenset) -> tuple[tuple, frozenset]:
        nodes: list[tuple] = []
        while (c := self.peek()) and c not in "|)":
            if self.at_repetition():
                raise InvalidPattern("nothing to repeat")
            found, flags = self.atom(flags)
            if not found:
                continue
            *before, last = found
            nodes += before
            nodes.append(self.repeated(last))
        return (nodes[0] if len(nodes) == 1 else ("cat", nodes)), flags

    def at_repetition(self) -> bool:
        c = self.peek()
        return c != "" and c in "*+?" or c == "{" and _BOUNDS.match(self.p, self.i) is not None

    def repeated(self, node: tuple) -> tuple:
        if not self.at_repetition():
            return node
        if (c := self.peek()) == "{":
            m = _BOUNDS.match(self.p, self.i)
            least = int(m[1])
            most = least if m[2] is None else int(m[3]) if m[3] else None
            if least > MOST_REPEATS or (most or 0) > MOST_REPEATS or (most is not None and most < least):
                raise InvalidPattern("bad repetition")
            self.i = m.end()
        else:
            self.take()
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        if self.peek() == "?":
            self.take()
        if self.at_repetition():
            raise InvalidPattern("repetition of a repetition")
        return ("repeat", node, least, most)

    def atom(self, flags: frozenset) -> tuple[list[tuple], frozenset]:
        c = self.take()
        if c == "(":
            return self.group(flags)
        if c == "[":
            return [self.klass("i" in flags)], flags
        if c == ".":
            return [("class", _EVERYTHING, False) if "s" in flags else ("any",)], flags
        if c == "^":
            return [("anchor", "line_begin" if "m" in flags else "begin")], flags
        if c == "$":
            return [("anchor", "line_end" if "m" in flags else "end")], flags
        if c == "\\":
            return self.escape("i" in flags), flags
        return [_char(c, "i" in flags)], flags

    def group(self, flags: frozenset) -> tuple[list[tuple], frozenset]:
        inner = flags
        if self.peek() == "?":
            self.take()
            if m := _NAME.match(self.p, self.i):
                if m[1] in self.names:
                    raise InvalidPattern("two groups of one name")
                self.names.add(m[1])
                self.i = m.end()
            elif m := _FLAGS.match(self.p, self.i):
                self.i = m.end()
                inner = (flags | frozenset(m[1])) - frozenset(m[2] or "")
                if m[3] == ")":
                    return [], inner
            else:
                raise InvalidPattern("this kind of group")
        node = self.alternatives(inner)
        if self.peek() != ")":
            raise InvalidPattern("a group isn't closed")
        self.take()
        return [("group", node)], flags

    def hexadecimal(self) -> str:
        m = _HEX.match(self.p, self.i)
        if not m or int(m[1] or m[2], 16) > 0x10FFFF:
            raise InvalidPattern("bad character code")
        self.i = m.end()
        return chr(int(m[1] or m[2], 16))

    def octal(self, c: str) -> str:
        m = _OCTAL.match(self.p, self.i)
        if c != "0" and not m:
            raise InvalidPattern("back references")
        digits = c + (m[0] if m else "")
        self.i += len(digits) - 1
        return chr(int(digits, 8))

    def character(self, c: str) -> str:
        """The character that an escaped ``c`` stands for, within and outside of classes."""
        if c in _CONTROLS:
            return _CONTROLS[c]
        if c == "x":
            return self.hexadecimal()
        if c in "01234567":
            return self.octal(c)
        if c.isalnum() and c.isascii():
            raise InvalidPattern(f"no escape \\{c}")
        return c

    def escape(self, fold: bool) -> list[tuple]:
        c = self.take()
        if c in _ANCHORS:
            return [("anchor", _ANCHORS[c])]
        if c.lower() in _CLASSES:
            return [("class", ("^" if c.isupper() else "") + _CLASSES[c.lower()], fold)]
        if c in "pP":
            return [("class", self.property(c == "P"), fold)]
        if c == "C":
            return [("class", _EVERYTHING, False)]
        if c == "Q":
            end = self.p.find("\\E", self.i)
            text = self.p[self.i :] if end < 0 else self.p[self.i : end]
            self.i = len(self.p) if end < 0 else end + 2
            return [_char(x, fold) for x in text]
        return [_char(self.character(c), fold)]

    def property(self, negated: bool) -> str:
        m = _PROPERTY.match(self.p, self.i)
        if not m:
            raise InvalidPattern("bad property")
        self.i = m.end()
        name = m[1] or m[2]
        if name.startswith("^"):
            negated, name = not negated, name[1:]
        if name == "Any":
            if negated:
                raise InvalidPattern("a class of nothing")
            return _EVERYTHING
        if name not in _CATEGORIES and name not in _SCRIPTS:
            raise InvalidPattern("an unknown property")
        return ("\\P{" if negated else "\\p{") + ("Is" if name in _SCRIPTS else "") + name + "}"

    def klass(self, fold: bool) -> tuple:
        negated = self.peek() == "^"
        if negated:
            self.take()
        out, first = [], True
        while True:
            c = self.take()
            if c == "]" and not first:
                break
            first = False
            if c == "[" and (m := _POSIX_NAME.match(self.p, self.i)):
                if m[2] not in _POSIX:
                    raise InvalidPattern("no such class")
                self.i = m.end()
                out.append((_POSIX_NEGATED if m[1] else _POSIX)[m[2]])
                continue
            if c == "\\" and self.peek() and self.peek() in "dDwWsSpP":
                c = self.take()
                out.append(self.property(c == "P") if c in "pP" else _CLASSES[c] if c in _CLASSES else _NEGATED[c.lower()])
                continue
            low = self.character(self.take()) if c == "\\" else c
            if self.peek() == "-" and self.peek(2)[1:] not in ("]", ""):
                self.take()
                c = self.take()
                high = self.character(self.take()) if c == "\\" else c
                if high < low:
                    raise InvalidPattern("bad range")
                out.append(f"{_class_char(low)}-{_class_char(high)}")
            else:
                out.append(_class_char(low))
        return ("class", ("^" if negated else "") + "".join(out), fold)


def _char(c: str, fold: bool) -> tuple:
    return ("char", c, fold and (c.lower() != c or c.upper() != c))


def _most_rounds(node: tuple) -> int:
    """Rounds of nested repetitions multiplied: the dialect refuses more than ``MOST_REPEATS`` altogether."""
    if node[0] in ("cat", "alt"):
        return max(map(_most_rounds, node[1]), default=1)
    if node[0] == "group":
        return _most_rounds(node[1])
    if node[0] == "repeat":
        rounds = node[2] if node[3] is None else node[3]
        return max(rounds, 1) * _most_rounds(node[1])
    return 1


@lru_cache(maxsize=10_000)
def parse(pattern: str) -> tuple:
    """The tree of a pattern; raises :class:`InvalidPattern`."""
    parser = _Parser(pattern)
    try:
        node = parser.alternatives(frozenset())
        if parser.i < len(pattern):
            raise InvalidPattern("a group is closed that isn't open")
        if _most_rounds(node) > MOST_REPEATS:
            raise InvalidPattern("too many repetitions")
    except RecursionError:
        raise InvalidPattern("nested too deeply") from None
    return node


def is_valid(pattern: str | None) -> bool:
    """Whether the dialect has this pattern."""
    try:
        return pattern is not None and parse(pattern) is not None
    except InvalidPattern:
        return False


# -- translation ------------------------------------------------------------------------------------------------


def _single(node: tuple) -> str | None:
    """The class text of a node that is one character of a few, else None."""
    if node[0] == "group":
        return _single(node[1])
    if node[0] == "char" and not node[2]:
        return _class_char(node[1])
    if node[0] == "class" and not node[1].startswith("^") and not node[2]:
        return node[1]
    if node[0] == "alt":
        parts = [_single(n) for n in node[1]]
        return "".join(parts) if all(parts) else None
    return None


_WORD_EDGE = {
    "word": "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))",
    "no_word": "(?:(?<![0-9A-Za-z_])(?![0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_]))",
}


class _Writer:
    """Writes a tree in the syntax of Java or of Python's ``regex``."""

    def __init__(self, java: bool) -> None:
        self.end, self.fold, self.last = (r"\z", "(?iu:", r"\x{10ffff}") if java else (r"\Z", "(?i:", r"\U0010ffff")

    def literal(self, c: str) -> str:
        return re.escape(c) if not c.isspace() or c == " " else f"\\x{ord(c):02x}" if ord(c) < 256 else c

    def klass(self, text: str) -> str:
        return "[" + text.replace(r"\U0010ffff", self.last) + "]"

    def write(self, node: tuple) -> str:
        kind = node[0]
        if kind == "char":
            return self.fold + self.literal(node[1]) + ")" if node[2] else self.literal(node[1])
        if kind == "any":
            return r"[^\n]"
        if kind == "class":
            return self.fold + self.klass(node[1]) + ")" if node[2] else self.klass(node[1])
        if kind == "anchor":
            return _WORD_EDGE.get(node[1]) or {"begin": r"\A", "end": self.end, "line_begin": r"(?:(?<=\n)|\A)", "line_end": rf"(?:(?=\n)|{self.end})"}[node[1]]
        if kind == "cat":
            return "".join(f"(?:{self.write(n)})" if n[0] == "alt" else self.write(n) for n in node[1])
        if kind == "alt":
            one = _single(node)
            return self.klass(one) if one else "|".join(map(self.write, node[1]))
        if kind == "group":
            return f"(?:{self.write(node[1])})"
        _, inner, least, most = node
        body = self.write(inner)
        if inner[0] in ("repeat", "cat", "alt", "anchor"):
            body = f"(?:{body})"
        return body + ({(0, None): "*", (1, None): "+", (0, 1): "?"}.get((least, most)) or "{%d%s}" % (least, "" if most == least else ",%s" % ("" if most is None else most)))


def _at_end(node: tuple) -> tuple | None:
    """A node at either end of the pattern: of a repetition only the least number of rounds matters (None: nothing)."""
    inner = node
    while inner[0] == "group":
        inner = inner[1]
    if inner[0] != "repeat":
        return node
    _, body, least, _ = inner
    return None if least == 0 else body if least == 1 else ("repeat", body, least, least)


def _trimmed(node: tuple) -> tuple:
    """The tree without what doesn't change whether there is a match: rounds beyond the least at either end."""
    nodes = list(node[1]) if node[0] == "cat" else [node]
    for end in (0, -1):
        while nodes:
            short = _at_end(nodes[end])
            if short == nodes[end]:
                break
            nodes[end : len(nodes) if end else 1] = [short] if short else []
    return ("cat", nodes)


def to_java(pattern: str) -> str:
    """An equivalent (as to whether there is a match) pattern for ``rlike``."""
    return _Writer(True).write(_trimmed(parse(pattern)))


def to_python(pattern: str) -> str:
    """The same for Python's ``regex`` module."""
    return _Writer(False).write(_trimmed(parse(pattern)))


def is_deep(pattern: str) -> bool:
    """Whether Java's matcher may run out of stack on long texts: a repeated group with a choice or a repetition in it."""

    def walk(node: tuple) -> bool:
        kind = node[0]
        if kind == "repeat":
            inner = node[1]
            if (node[3] is None or node[3] > 50) and _single(inner) is None and inner[0] not in ("any", "class", "char"):
                return True
            return walk(inner)
        if kind in ("cat", "alt"):
            return any(map(walk, node[1]))
        return kind == "group" and walk(node[1])

    return walk(_trimmed(parse(pattern)))


# -- literals ---------------------------------------------------------------------------------------------------


def sound_literals(pattern: str) -> list[str]:
    """Strings that every match of the pattern contains, in order; [] if the pattern is invalid or promises none.

    Literals stand outside all brackets, aren't repeated and don't ignore case.
    A choice at the top level gives none.
    """
    if not is_valid(pattern):
        return []
    node = parse(pattern)
    out, run = [], ""
    for n in [*(node[1] if node[0] == "cat" else [node]), ("any",)]:
        if n[0] == "char" and not n[2]:
            run += n[1]
        else:
            if run:
                out.append(run)
            run = ""
    return out


# Escapes that the compatible reading takes as metacharacters, and its brackets.
_COMPAT_CLASSES = "wWabBdDlpsSuxz"
_OPENERS, _CLOSERS = "([{", {")": "(", "]": "[", "}": "{"}


def _odd_backslashes(s: str, i: int) -> bool:
    """Whether the character at i is escaped: an odd number of backslashes before it."""
    n = 0
    while i - n - 1 >= 0 and s[i - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def remove_escapes(s: str) -> str:
    """``s`` without backslashes."""
    return s.replace("\\", "")


def is_special(s: str) -> bool:
    """Empty, or with an unescaped ``^ $ . |``, or with an escaped class letter."""
    return not s or any((c in "^$.|" and not _odd_backslashes(s, i)) or (c in _COMPAT_CLASSES and _odd_backslashes(s, i)) for i, c in enumerate(s))


def compat_literals(pattern: str) -> list[str]:
    """The literals as the classic scanner of this problem reads them: simpler, and unsound for many patterns.

    Metacharacters and class escapes outside brackets vanish without ending a
    literal, braces are brackets like any other, and a repetition sign that
    stands anywhere but after a bracket makes the whole pattern useless.  A
    bracket that stays open hides what follows it.
    """
    out: list[str] = []
    literal: list[str] = []
    open_brackets: list[str] = []
    closed_at = -2
    escaped = False
    for i, c in enumerate(pattern):
        if not escaped and c == "\\":
            escaped = True
            continue
        bare = not escaped
        if c in "*+?":  # also within brackets
            if closed_at != i - 1 and (literal or i == 0):
                return []
            continue  # the sign leaves an escape standing
        if bare and c in _OPENERS:
            if not open_brackets and literal:
                out.append("".join(literal))
                literal = []
            open_brackets.append(c)
        elif bare and c in _CLOSERS:
            if not open_brackets or open_brackets.pop() != _CLOSERS[c]:
                return []
            if not open_brackets:
                closed_at = i
        elif open_brackets or (bare and c in "^$.|") or (not bare and c in _COMPAT_CLASSES):
            pass
        elif not bare and c in "nt":
            literal.append({"n": "\n", "t": "\t"}[c])
        else:
            literal.append(c)
        escaped = False
    return out + (["".join(literal)] if literal else [])


def literals(pattern: str, mode: str = "sound") -> list[str]:
    """Literals of a pattern; ``mode`` is ``sound`` or ``compat``."""
    return sound_literals(pattern) if mode == "sound" else compat_literals(pattern)


# -- other rewrites ---------------------------------------------------------------------------------------------


# The published PROSITE notation, sign by sign.
_PROSITE = {"-": "", "x": ".", "{": "[^", "}": "]", "(": "{", ")": "}", "<": "^", ">": "$"}


def prosite_to_regex(motif: str) -> str:
    """A PROSITE motif as a regular expression.

    The motif is read sign by sign; a final full stop ends it, and a last
    element ``[...>]`` or ``[...$]`` (one of these residues or the end of the
    sequence) becomes a choice with the end of the text.
    """
    motif = motif.strip().rstrip(".")
    last = re.fullmatch(r"(.*)\[([^\[\]]*)[$>]\]", motif, re.S)
    head, end = (last[1], f"([{last[2]}]|\\z)" if last[2] else r"\z") if last else (motif, "")
    return "".join(_PROSITE.get(c, c) for c in head) + end
