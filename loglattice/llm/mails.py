"""The sender's own prose of a stored mail."""

from __future__ import annotations

import binascii
import html
import re

_ENVELOPE = re.compile(r">?From \S+ [^\n]*\d{4}[^\n]*\n")
_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
_BOUNDARY = re.compile(r'boundary="?([^"\s;]+)', re.I)
_CHARSET = re.compile(r'charset="?([\w.:-]+)', re.I)
_TAG = re.compile(r"<[^<>]*>")
_BLOCK_TAG = re.compile(r"<\s*(?:br|/p|/div|/li|/tr|blockquote|/blockquote)\b[^<>]*>", re.I)
_DROPPED_HTML = re.compile(r"<(style|script|head|blockquote)\b.*?</\1\s*>", re.I | re.S)
_RULE = re.compile(r"\s*_{5,}\s*\Z")
_SIGNATURE = re.compile(r"--\s?\Z")
_LEAD = re.compile(r".*\d{1,4}[./-]\d{1,2}[./-]\d{1,4}.*:\s*\Z", re.S)
_ORIGINAL = re.compile(r"\s*-{3,}\s*\S.*\S\s*-{3,}\s*\Z")
_BASE64 = re.compile(r"[A-Za-z0-9+/=\s]*\Z")
_MOJIBAKE = re.compile("[Â-ÅÐÑ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")


def headers_of(head: str) -> dict[str, str]:
    """Header fields by lower-case name, folded lines joined; the first of equal names counts."""
    out: dict[str, str] = {}
    name = None
    for line in head.split("\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif _HEADER.match(line):
            key, _, value = line.partition(":")
            name = key.lower()
            if name in out:
                name = None
            else:
                out[name] = value.strip()
    return out


def _text_of(raw: bytes, charset: str) -> str:
    """UTF-8 where the bytes are valid, whatever was declared; else the declared charset or windows-1252."""
    for name in ("utf-8", charset, "cp1252", "latin-1"):
        try:
            return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace")


def _decoded(body: str, encoding: str, charset: str) -> str:
    encoding = encoding.lower()
    if encoding == "quoted-printable":
        return _text_of(binascii.a2b_qp(body.encode("utf-8", "surrogatepass")), charset)
    if encoding == "base64":
        packed = "".join(body.split())
        if not _BASE64.match(packed):
            packed = re.sub(r"[^A-Za-z0-9+/]", "", packed)
        packed = packed.rstrip("=")
        packed = packed[: len(packed) - (len(packed) % 4 == 1)]
        try:
            return _text_of(binascii.a2b_base64(packed + "=" * (-len(packed) % 4)), charset)
        except binascii.Error:
            return ""
    return body


def _unspoiled(text: str) -> str:
    """UTF-8 that was read as a one-byte charset is read again, where a line allows it."""
    if not _MOJIBAKE.search(text):
        return text
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if _MOJIBAKE.search(line):
            for name in ("latin-1", "cp1252"):
                try:
                    lines[i] = line.encode(name).decode("utf-8")
                    break
                except (UnicodeEncodeError, UnicodeDecodeError):
                    continue
    return "\n".join(lines)


def _plain(markup: str) -> str:
    return html.unescape(_TAG.sub(" ", _BLOCK_TAG.sub("\n", _DROPPED_HTML.sub("\n", markup))))


def _part(text: str, inner: bool) -> tuple[list[str], tuple[str, str] | None]:
    """(inner parts of a multipart in order, None), or ([], its kind and decoded text); nothing of an attachment."""
    head, _, body = text.partition("\n\n")
    first = head.lstrip("\n").split("\n", 1)[0]
    if not _HEADER.match(first):
        head, body = ("", text[1:]) if inner and text.startswith("\n") else ("", text)
    fields = headers_of(head)
    kind = fields.get("content-type", "text/plain")
    low = kind.lower()
    if low.startswith("multipart/") and (mark := _BOUNDARY.search(kind)):
        cut = ("\n" + body).split("\n--" + mark.group(1))[1:]
        end = next((k for k, part in enumerate(cut) if part.startswith("--")), len(cut))
        return [part.partition("\n")[2] for part in cut[:end]], None
    if fields.get("content-disposition", "").lower().startswith("attachment") or not low.startswith("text/"):
        return [], None
    charset = _CHARSET.search(kind)
    return [], (low.split(";")[0].strip(), _decoded(body, fields.get("content-transfer-encoding", ""), charset.group(1) if charset else "utf-8"))


def _parts(text: str) -> list[tuple[str, str]]:
    """(kind, decoded text) of the plain and html parts that are no attachments, in order, however deep they are nested."""
    if envelope := _ENVELOPE.match(text):
        text = text[envelope.end() :]
    out, waiting = [], [(text, False)]
    while waiting:
        inner, found = _part(*waiting.pop())
        if found:
            out.append(found)
        waiting += [(part, True) for part in reversed(inner)]
    return out


def prose_lines(text: str | None) -> list[str]:
    """Lines of the sender's own prose, decoded; [] for null, empty and blank texts.

    Left out: headers, attachments, html where a plain part says the same, quotes with their lead-ins, everything from
    a signature mark or the rule above a disclaimer, and lines that are no prose (tables, logs, code).
    """
    if not text or not text.strip():
        return []
    parts = _parts(text.replace("\r\n", "\n").replace("\r", "\n"))
    plain = [t for k, t in parts if k != "text/html" and t.strip()]
    chosen = plain or [_plain(t) for k, t in parts if k == "text/html"]
    out: list[str] = []
    for body in chosen:
        lines = _unspoiled(body.replace("\r\n", "\n").replace("\r", "\n")).split("\n")
        own: list[str] = []
        for line in lines:
            if line.lstrip().startswith((">", "|>")):
                while own and not own[-1].strip():
                    own.pop()
                if own and _LEAD.match(own[-1]):
                    own.pop()
                elif len(own) > 1 and _LEAD.match(own[-2] + " " + own[-1]):
                    del own[-2:]
                own.append("")
                continue
            if _SIGNATURE.match(line) or _RULE.match(line) or _ORIGINAL.match(line):
                break
            own.append(line)
        while own and not own[-1].strip():
            own.pop()
        if own and _LEAD.match(own[-1]):
            own.pop()
        out += own
    return out
