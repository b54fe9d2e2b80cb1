"""Text of PDF files, page by page, by the standard library.

Reads plain and Flate streams, object streams, and fonts with a ToUnicode map or a
Latin encoding. Files that are encrypted or compressed in other ways are errors.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|[\[\]]|/[^\s/<>\[\]()]+|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z*'\"]+", re.DOTALL)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.DOTALL)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _stream(body: bytes) -> bytes:
    """What an object's stream holds, unpacked; empty without one."""
    start = re.search(rb"\bstream\r?\n", body)
    if not start:
        return b""
    head, data = body[: start.start()], body[start.end() : body.rindex(b"endstream")]
    if b"/FlateDecode" in head:
        return zlib.decompressobj().decompress(data)
    if b"/Filter" in head:
        raise ValueError("unknown stream filter")
    return data


def _objects(data: bytes) -> dict[int, bytes]:
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise ValueError("the file is encrypted")
    found = {int(n): body for n, body in _OBJECT.findall(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body[:200]:
            inner, first = _stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            at = list(map(int, inner[:first].split()))
            starts = [*at[1::2], len(inner) - first]
            found |= {n: inner[first + a : first + b] for n, a, b in zip(at[::2], starts, starts[1:], strict=False)}
    return found


def _entry(body: bytes, key: bytes) -> bytes:
    """What follows a key in a dictionary: a reference, a list or a dictionary with its brackets, else empty."""
    at = re.search(key + rb"\s*(?=[\[<\d])", body)
    if not at:
        return b""
    rest = body[at.end() :]
    if ref := re.match(_REF, rest):
        return ref[0]
    opening, closing = (b"[", b"]") if rest[:1] == b"[" else (b"<<", b">>")
    depth = i = 0
    while i < len(rest):
        if rest.startswith(opening, i):
            depth, i = depth + 1, i + len(opening)
        elif rest.startswith(closing, i):
            depth, i = depth - 1, i + len(closing)
            if not depth:
                return rest[:i]
        else:
            i += 1
    return b""


def _resolved(objects: dict[int, bytes], value: bytes) -> bytes:
    ref = re.fullmatch(_REF, value.strip()) if value else None
    return objects.get(int(ref[1]), b"") if ref else value


def _pages(objects: dict[int, bytes]) -> list[tuple[bytes, bytes]]:
    """(page, resources) in reading order."""
    out: list[tuple[bytes, bytes]] = []

    def walk(body: bytes, resources: bytes, depth: int) -> None:
        own = _resolved(objects, _entry(body, rb"/Resources")) or resources
        kids = _resolved(objects, _entry(body, rb"/Kids"))
        if kids and depth < 50:
            for n in _REF.findall(kids):
                walk(objects.get(int(n), b""), own, depth + 1)
        elif body:
            out.append((body, own))

    catalog = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    walk(_resolved(objects, _entry(catalog, rb"/Pages")), b"", 0)
    return out


def _unicode_map(cmap: bytes) -> dict[bytes, str]:
    """Code to text, from the bfchar and bfrange parts of a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            first, base = int(a, 16), text(c)
            for i in range(min(int(b, 16) - first, 65535) + 1):
                out[(first + i).to_bytes(len(a) // 2, "big")] = base[:-1] + chr(ord(base[-1]) + i)
    return out


def _fonts(objects: dict[int, bytes], resources: bytes) -> dict[bytes, dict[bytes, str]]:
    listed = _resolved(objects, _entry(resources, rb"/Font"))
    found = {}
    for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed):
        cmap = _resolved(objects, _entry(objects.get(int(n), b""), rb"/ToUnicode"))
        if cmap:
            found[name] = _unicode_map(_stream(cmap))
    return found


def _shown(token: bytes, font: dict[bytes, str] | None) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1]).decode()
        raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else _PLAIN.get(m[1], m[1]), token[1:-1])
    if not font:
        return raw.decode("cp1252", "replace")
    width = len(next(iter(font)))
    return "".join(font.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def _text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    out: list[str] = []
    held: list[bytes] = []
    font: dict[bytes, str] | None = None
    line = "\n"
    for token in _TOKEN.findall(content):
        if not (token[:1].isalpha() or token in (b"'", b'"')):
            held.append(token)
            continue
        strings = [t for t in held if t[:1] in (b"(", b"<")]
        if token == b"Tf" and held:
            font = fonts.get(held[0][1:]) if held[0][:1] == b"/" else font
        elif token == b"TJ":
            for t in held:
                if t[:1] in (b"(", b"<"):
                    out.append(_shown(t, font))
                elif t[:1] == b"-" and float(t) < -200:
                    out.append(" ")  # a gap as wide as a blank
        elif token in (b"Tj", b"'", b'"'):
            out += [line] * (token != b"Tj") + [_shown(t, font) for t in strings[-1:]]
        elif token == b"T*" or (token in (b"Td", b"TD") and len(held) > 1 and float(held[-1])) or token in (b"Tm", b"ET"):
            out.append(line)
        held = []
    return re.sub(r"\n+\Z", "", re.sub(r"\A\n+", "", "".join(out)))


def pdf_pages(data: bytes) -> list[str]:
    """Text of each page."""
    if not data.lstrip().startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    objects = _objects(data)
    out = []
    for page, resources in _pages(objects):
        contents = _entry(page, rb"/Contents")
        inner = _resolved(objects, contents)
        parts = [_stream(objects.get(int(n), b"")) for n in _REF.findall(inner)] if inner[:1] == b"[" else [_stream(inner)]
        out.append(_text(b"\n".join(parts), _fonts(objects, resources)))
    return out
