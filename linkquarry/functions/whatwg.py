"""Parsing and serialisation of http and https URLs as the WHATWG URL standard describes it, without Spark."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

try:
    import idna
except ImportError:  # the Unicode rules of the standard library serve then
    idna = None

PORTS = {"http": "80", "https": "443"}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_ASCII_ESCAPED = {"fragment": ' "<>`', "query": " \"#<>'", "path": ' "#<>?`{}^', "userinfo": ' "#<>?`{}/:;=@[\\]^|'}
_ESCAPED = {k: frozenset(v) for k, v in _ASCII_ESCAPED.items()}
_HOST_FORBIDDEN = frozenset(" #/:<>?@[\\]^|%") | {chr(c) for c in range(0x20)} | {"\x7f"}


class InvalidUrl(ValueError):
    pass


def escape(text: str, where: str) -> str:
    """Percent-encode what the part's set asks for; lone surrogates become U+FFFD."""
    special = _ESCAPED[where]
    if all(" " < c < "\x7f" and c not in special for c in text):
        return text
    out = []
    for c in text:
        if " " <= c < "\x7f" and c not in special:
            out.append(c)
        else:
            plain = "\ufffd" if "\ud800" <= c <= "\udfff" else c
            out += [f"%{b:02X}" for b in plain.encode("utf-8")]
    return "".join(out)


@dataclass
class Url:
    scheme: str
    username: str
    password: str
    host: str
    port: str
    path: str
    query: str | None
    fragment: str | None

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port else "")

    @property
    def search(self) -> str:
        return f"?{self.query}" if self.query else ""

    @property
    def hash(self) -> str:
        return f"#{self.fragment}" if self.fragment else ""

    @property
    def href(self) -> str:
        user = self.username + (f":{self.password}" if self.password else "")
        return (
            f"{self.scheme}://"
            + (f"{user}@" if user else "")
            + self.host
            + (f":{self.port}" if self.port else "")
            + self.path
            + (f"?{self.query}" if self.query is not None else "")
            + (f"#{self.fragment}" if self.fragment is not None else "")
        )

    def params(self) -> list[tuple[str, str]]:
        return parameters(self.query or "")


def form_decode(text: str) -> str:
    return unquote_to_bytes(text.replace("+", " ").encode("utf-8", "replace")).decode("utf-8", "replace")


def parameters(query: str) -> list[tuple[str, str]]:
    """Name and value pairs of a query, as a form is decoded; one leading question mark is not part of it."""
    pairs = []
    for part in query.removeprefix("?").split("&"):
        if part:
            name, _, value = part.partition("=")
            pairs.append((form_decode(name), form_decode(value)))
    return pairs


def _number(part: str) -> int | None:
    if not part:
        return None
    try:
        if part[:2].lower() == "0x":
            return int(part[2:] or "0", 16) if re.fullmatch("[0-9A-Fa-f]*", part[2:]) else None
        if len(part) > 1 and part[0] == "0":
            return int(part, 8) if re.fullmatch("[0-7]+", part) else None
        return int(part) if re.fullmatch("[0-9]+", part) else None
    except ValueError:
        return None


def _ipv4(host: str) -> str | None:
    """The dotted form of a host that ends in a number; None for other hosts."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    last = parts[-1]
    if not (re.fullmatch("[0-9]+", last) or re.fullmatch("0[xX][0-9A-Fa-f]*", last)):
        return None
    numbers = [_number(p) for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise InvalidUrl("host")
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _ipv6(text: str) -> str:
    if "%" in text:
        raise InvalidUrl("host")
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        raise InvalidUrl("host") from None
    groups = [value >> 16 * (7 - i) & 0xFFFF for i in range(8)]
    runs = [(len(m[0]), m.start()) for m in re.finditer("0+", "".join("0" if g == 0 else "x" for g in groups))]
    length, start = max(runs, key=lambda r: (r[0], -r[1]), default=(0, 0))
    words = [f"{g:x}" for g in groups]
    return "[" + (":".join(words[:start]) + "::" + ":".join(words[start + length :]) if length > 1 else ":".join(words)) + "]"


def _domain(text: str) -> str:
    host = unquote_to_bytes(text.encode("utf-8", "replace")).decode("utf-8", "replace")
    if host.isascii():
        return host.lower()
    if idna is not None:
        try:
            host = idna.uts46_remap(host, std3_rules=False, transitional=False)
        except idna.IDNAError:
            raise InvalidUrl("host") from None
    else:
        host = unicodedata.normalize("NFKC", host.lower()).replace("。", ".").replace("­", "")
    try:
        return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode("ascii") for x in host.split(".")).lower()
    except UnicodeError:
        raise InvalidUrl("host") from None


def _host(text: str) -> str:
    if text.startswith("["):
        if not text.endswith("]"):
            raise InvalidUrl("host")
        return _ipv6(text[1:-1])
    host = _domain(text)
    if not host or any(c in _HOST_FORBIDDEN for c in host):
        raise InvalidUrl("host")
    return _ipv4(host) or host


_SINGLE = {".", "%2e"}
_DOUBLE = {"..", ".%2e", "%2e.", "%2e%2e"}


def normal_path(text: str) -> str:
    """A path with dot segments resolved, back slashes turned and escapes added."""
    if not text:
        return "/"
    parts = re.split(r"[/\\]", text[1:] if text[0] in "/\\" else text)
    out: list[str] = []
    for i, part in enumerate(parts):
        low, last = part.lower(), i == len(parts) - 1
        if low in _DOUBLE:
            if out:
                out.pop()
            if last:
                out.append("")
        elif low in _SINGLE:
            if last:
                out.append("")
        else:
            out.append(escape(part, "path"))
    return "/" + "/".join(out)


def scheme_of(text: str) -> str | None:
    m = _SCHEME.match(trimmed(text))
    return m[1].lower() if m else None


def trimmed(text: str) -> str:
    return re.sub(r"[\t\n\r]", "", text.strip("".join(chr(c) for c in range(0x21))))


def parse(text: str) -> Url:
    """The URL, or InvalidUrl; schemes other than http and https are invalid here."""
    text = trimmed(text)
    m = _SCHEME.match(text)
    if not m or m[1].lower() not in PORTS:
        raise InvalidUrl("scheme")
    scheme, rest = m[1].lower(), text[m.end() :]
    rest, mark, fragment = rest.partition("#")
    fragment = escape(fragment, "fragment") if mark else None
    rest, mark, query = rest.partition("?")
    query = escape(query, "query") if mark else None
    rest = rest.lstrip("/\\")
    cut = re.search(r"[/\\]", rest)
    authority, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    user, at, host = authority.rpartition("@")
    name, _, secret = user.partition(":")
    port = ""
    if m := re.search(r":([^\]:]*)\Z", host):
        if m[1] and not (m[1].isascii() and m[1].isdigit() and int(m[1]) <= 65535):
            raise InvalidUrl("port")
        host, port = host[: m.start()], str(int(m[1])) if m[1] else ""
    if not host:
        raise InvalidUrl("host")
    return Url(scheme, escape(name, "userinfo"), escape(secret, "userinfo"), _host(host), "" if port == PORTS[scheme] else port, normal_path(path), query, fragment)
