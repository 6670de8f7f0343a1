"""Log-format strings to matching specifications, built on the driver.

A specification holds one Java regular expression whose groups carry roles. Rows are matched with a
single regexp_replace that writes the groups side by side (see operators.parse).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# The built-in formats.
HTTP_LOG = "%ci:%cp [%tr] %ft %b/%s %TR/%Tw/%Tc/%Tr/%Ta %ST %B %CC %CS %tsc %ac/%fc/%bc/%sc/%rc %sq/%bq %hr %hs %{+Q}r"
HTTPS_LOG = HTTP_LOG + " %[fc_err]/%[ssl_fc_err,hex]/%[ssl_c_err]/%[ssl_c_ca_err]/%[ssl_fc_is_resumed] %[ssl_fc_sni]/%sslv/%sslc"
TCP_LOG = "%ci:%cp [%t] %ft %b/%s %Tw/%Tc/%Tt %B %ts %ac/%fc/%bc/%sc/%rc %sq/%bq"

# Pattern of each variable, and its role where the record uses it.
_DATE = r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}"
_TIMER, _COUNT = r"\+?-?\d+", r"\+?\d+"
VARIABLES: dict[str, tuple[str, str | None]] = {
    "ci": (r"\S+", "client"), "cp": (r"\d+", None), "fi": (r"\S+", None), "fp": (r"\d+", None),
    "bi": (r"\S+", None), "bp": (r"\d+", None), "si": (r"\S+", None), "sp": (r"\d+", None),
    "tr": (_DATE + r"\.\d{3}", "date_ms"), "t": (_DATE + r"\.\d{3}", "date_ms"),
    "trg": (_DATE + r" [+-]\d{4}", "date_tz"), "trl": (_DATE + r" [+-]\d{4}", "date_tz"),
    "T": (_DATE + r" [+-]\d{4}", "date_tz"), "Tl": (_DATE + r" [+-]\d{4}", "date_tz"),
    "Ts": (r"\d+", "date_unix"), "ms": (r"\d{3}", None),
    "ft": (r"\S+", "frontend"), "f": (r"\S+", "frontend"), "b": (r"\S+", "backend"), "s": (r"\S+", "server"),
    "TR": (_TIMER, None), "Tw": (_TIMER, None), "Tc": (_TIMER, None), "Tr": (_TIMER, None), "Th": (_TIMER, None),
    "Ti": (_TIMER, None), "Tq": (_TIMER, None), "Tu": (_TIMER, None), "Td": (_TIMER, None),
    "Ta": (_TIMER, "ta"), "Tt": (_TIMER, "tt"), "ST": (r"-?\d+", "status"),
    "B": (_COUNT, None), "U": (_COUNT, None), "CC": (r"\S+", None), "CS": (r"\S+", None),
    "tsc": (r"\S{4}", "term"), "ts": (r"\S{2}", "term"),
    "ac": (_COUNT, None), "fc": (_COUNT, None), "bc": (_COUNT, None), "sc": (_COUNT, None), "rc": (_COUNT, None),
    "sq": (_COUNT, None), "bq": (_COUNT, None), "lc": (r"\d+", None), "rt": (r"\d+", None), "pid": (r"\d+", None),
    "hr": (r"\{[^}]*\}", "captures"), "hs": (r"\{[^}]*\}", None), "hrl": (r"\S*", None), "hsl": (r"\S*", None),
    "r": (r"\S+ \S+(?: \S+)?", "request"), "HM": (r"\S+", "method"), "HU": (r"\S+", "uri"),
    "HP": (r"\S+", "path"), "HPO": (r"\S+", "path"), "HQ": (r"\S*", None), "HV": (r"\S+", None), "H": (r"\S+", None),
    "ID": (r"\S*", None), "sslc": (r"\S+", None), "sslv": (r"\S+", None), "o": ("", None),
}
#: Left out together with the following space when empty.
OPTIONAL = {"hr", "hs", "hrl", "hsl", "o"}
#: Expressions that give the Host header.
HOST_EXPRESSIONS = ("req.hdr(host", "req.fhdr(host", "hdr(host", "req.hdr_ip(host", "req.hdr(:authority", "req.fhdr(:authority")

_NAMES = "|".join(sorted(VARIABLES, key=lambda v: -len(v)))
#: A piece of a format: %%, a variable with its flags (by name, or by an expression in brackets), or text;
#: a % whose flags are not closed is text.
_PIECE = re.compile(rf"(?P<escape>%%)|%(?:\{{(?P<flags>[^}}]*)\}}|(?!\{{))(?:(?P<open>\[)|(?P<name>{_NAMES}|[A-Za-z]*))|(?P<text>[^%]+|%)")
SEPARATOR = "\x01"


@dataclass(frozen=True)
class FormatSpec:
    """``regex`` with ``roles`` for its groups; a role may carry a number (capture slot)."""

    source: str
    regex: str
    roles: tuple[str, ...] = field(default=())

    @property
    def template(self) -> str:
        return SEPARATOR.join(f"${i}" for i in range(1, len(self.roles) + 1))

    def group(self, role: str) -> int | None:
        """Number (from 0) of the last group with a role, as a later field overrides an earlier."""
        return max((i for i, r in enumerate(self.roles) if r == role), default=None)


def _expression(text: str) -> str | None:
    """Role of a sample expression."""
    flat = text.lower().replace(" ", "")
    if flat.startswith(HOST_EXPRESSIONS):
        return "host"
    if flat.startswith("ssl_fc_sni"):
        return "sni"
    slot = re.match(r"capture\.req\.hdr\((\d+)\)(?:,|$)", flat)
    return f"slot{slot[1]}" if slot else None


def _closing(source: str, at: int) -> int:
    """Where the bracket that opens at ``at`` is closed, or the end."""
    depth = 0
    for bracket in re.compile(r"[\[\]]").finditer(source, at):
        depth += 1 if bracket[0] == "[" else -1
        if depth == 0:
            return bracket.start()
    return len(source)


def _items(source: str) -> list[tuple[str, str | None, bool] | str]:
    """Literal strings and (pattern, role, optional) of variables, in order."""
    variables: list = []
    texts, at = [""], 0  # texts[k] stands before variables[k]
    while at < len(source):
        piece = _PIECE.match(source, at)
        at = piece.end()
        if (plain := "%" if piece["escape"] else piece["text"]) is not None:
            texts[-1] += plain
            continue
        pattern, role = VARIABLES.get(piece["name"] or "", (r"\S*", None))
        if piece["open"]:
            end = _closing(source, at - 1)
            role, at = _expression(source[at:end]), end + 1
        elif piece["name"] == "Ts" and "+X" in (piece["flags"] or ""):
            pattern, role = "[0-9A-Fa-f]+", "date_hex"
        if pattern:
            quoted = r'"[^"]*"|-' if "+Q" in (piece["flags"] or "") else pattern
            variables.append((quoted, role, piece["name"] in OPTIONAL))
            texts.append("")
    return [x for pair in zip(texts, [*variables, ""]) for x in pair if x]


def compile_format(source: str) -> FormatSpec:
    """One anchored regular expression; fields appended after the format are a trailing group."""
    items, parts, roles = _items(source), ["^"], []
    for i, item in enumerate(items):
        if isinstance(item, str):
            parts.append(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", item))
            continue
        pattern, role, optional = item
        group = f"({pattern})" if role else f"(?:{pattern})"
        if role:
            roles.append(role)
        if optional:
            follows = items[i + 1] if i + 1 < len(items) else ""
            spaced = isinstance(follows, str) and follows.startswith(" ")
            if spaced:
                items[i + 1] = follows[1:]
            group = f"(?:{group}{' ' if spaced else ''})?"
        parts.append(group)
    parts.append(r"(?:\s+(.*?))?\s*$")
    return FormatSpec(source, "".join(parts), (*roles, "trailing"))


DEFAULT_FORMATS = (HTTP_LOG, TCP_LOG)


def format_specs(formats: list[str] | None = None) -> list[FormatSpec]:
    """Configured formats first, then the built-in ones, each once."""
    return [compile_format(f) for f in dict.fromkeys([*(formats or []), *DEFAULT_FORMATS]) if f]
