"""A small labelled table for personal data, written for this library: sentences with places for values, filled by seeded rules.

{email}, {ip}, {card} and {phone} are labelled; the other names in braces are numbers and codes that are no personal data. {w} is an invented word, so
that unknown words stand around everything. No value of the given tables is in it.
"""

from __future__ import annotations

import random
import re

#: How often each sentence is filled.
COPIES = 12
SEED = 11

SENTENCES = [
    "{w} {w} {email} {w} {w}.", "{w}, {email}", "Write to {email} {w} {w}.", "mail: {email}; {w}", "<{email}> {w}", "({email}) {w} {w}", "{w} {email}, {email} {w}", "contact {email} or call {phone}.", "E-Mail {email} {w}",
    "{w} {w} {ip} {w} {w}.", "host {ip} {w}", "from {ip} to {ip}", "IP: {ip}, {w}", "{w} ({ip}) {w}", "{w} [{ip}] {w} {time}", "server at {ip} {w} since {date}", "ping {ip}",
    "{w} {w} {card} {w} {w}.", "card {card}, {w}", "Visa: {card} {w}", "paid with {card} on {date}.", "{w} ({card}) {w}", "number {card} {card} {w}",
    "{w} {w} {phone} {w} {w}.", "call {phone} {w}", "Tel. {phone}, {w}", "phone: {phone}", "{w} {w}: {phone} {w}", "fax {phone}; {email}", "reach us on {phone} or {phone}", "{w} ({phone}) {w}", "mobile {phone} {w} {time}",
    "{w} {w} {date} {w} {w}.", "on {date} at {time} {w}", "{w} {price} {w} {price}", "{w} {order} {w} {w}.", "order {order}, {w}", "order no. {order} {w} of {date}", "ISBN {isbn} {w}", "version {version} {w} {w}", "{w} {version} {w}", "{w} {range} {w}", "pages {range}, {w}", "{w} {number} {w} {number} {w}.",
    'token = "{hex}" {w}', '{w} key: {hex}', "{w} {hex} {w}", "id {hex}, {w}", "{w} @{w} {w} {w}", "meet @ {time} {w}", "{number} @ {price} {w}", "{w}@{w} {w}", "section {section} {w}", "see {section}, {w}", "{w} {coordinates} {w}", "{w} {numbers} {w}", "{w} {badip} {w}", "build {badip} {w}", "{w} {long} {w}", "tracking {long} {w}", "{w} {url} {w}",
    "{w} at {w} {number} {w}", "at {w} {w} {long} {w} at {w}", "at {w} {card} {w} at {w}", "{w} at {w} {email} at {w}", "at {w} {phone} {w}", "{w} of {w} at {ip} {w}", "{phone} {ip} {w}", "{email} {long} {w}", "{long} {w} {email}", "{card} {email} {phone} {ip}", "at {number} {w}", "{w} {w} dot {w} {w} {w}.", "the dot at the end {w} {w}", "{w} {score} {w} {score}", "{number} {w} and {number} {w} in {year}", "© {year} {w} {w}", "{w} ({year}) {w} {year}.", "{w}&&& {number}### {w}%%% {long}$$$", "{w}&&& {phone}%%% {w}", "{w}*** {email}&&& {w}", "{w} #{number} {w} ({number})", "{w} [{number}] {w} [{number}]", "chapter {number}: {w} {w}", "{date} {time} {w} {number}", "{w} {badcard} {w}", "{w} {w} (at) {w} {w}", "MIT License {year} {w} v{version}", "{w} {size} {w} {size}",
]

_CONSONANTS, _VOWELS = "bcdfghjklmnprstvwxzßçñ", "aeiouyéöü"
_HOSTS, _ENDS = "mail post office corp web uni news shop".split(), "com org net example.com co.uk de fr io".split()


def _syllables(r: random.Random, most: int, plain: bool = False) -> str:
    n = 20 if plain else len(_CONSONANTS)
    return "".join(_CONSONANTS[r.randrange(n)] + _VOWELS[r.randrange(6 if plain else 9)] + (r.choice(_CONSONANTS[:20]) if r.random() < 0.4 else "") for _ in range(r.randint(1, most)))


def _word(r: random.Random) -> str:
    if r.random() < 0.12:
        return r.choice(["at", "at", "At", "the", "of", "a", "to", "in"])
    out = _syllables(r, 4)[r.randrange(2) :]
    return r.choice([out, out, out, out.capitalize(), out.upper()]) + r.choice(["", "", "", "", ",", ".", "-" + _syllables(r, 1)])


def _around(r: random.Random) -> str:
    return " ".join(_word(r) for _ in range(r.randrange(5)))


def _plain(r: random.Random) -> str:
    return _syllables(r, 3, plain=True)


def _digits(r: random.Random, n: int) -> str:
    return "".join(str(r.randrange(10)) for _ in range(n))


def _luhn(digits: str) -> bool:
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _email(r: random.Random) -> str:
    user = r.choice([_plain(r), f"{_plain(r)}.{_plain(r)}", f"{_plain(r)}.{_digits(r, 2)}", f"{_plain(r)}_{_plain(r)}{r.randrange(99)}"])
    host, end = r.choice([r.choice(_HOSTS), _plain(r), r.choice(_HOSTS) + str(r.randrange(9))]), r.choice(_ENDS)
    at = r.choice(["@", "@", "@", " @ ", "[at]", " [at] ", "(at)", " (at) ", " at "])
    dot = "." if "@" in at else r.choice([" dot ", "[dot]", "(dot)", " (dot) "] if at == " at " else [".", ".", "[dot]", " [dot] ", "(dot)", " dot "])
    return user + at + host + dot + end.replace(".", dot)


def _ip(r: random.Random) -> str:
    parts = [str(r.randrange(256)) for _ in range(4)]
    six = [f"{r.randrange(65536):x}" for _ in range(8)]
    return r.choice([".".join(parts), ".".join(parts), "[.]".join(parts), ":".join(six), ":".join(six[:3]) + "::" + ":".join(six[5:]), f"fe80::{six[0]}:{six[1]}"])


def _card(r: random.Random, good: bool = True) -> str:
    while _luhn(n := r.choice("3456") + _digits(r, 15)) != good:
        pass
    gap = r.choice(["", "", " ", "-", ".", "/", " - ", "  "]) if good else r.choice(["", " ", "-"])
    return gap.join(n[i : i + 4] for i in range(0, 16, 4))


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
    a = str(r.randrange(2, 10)) + a[1:]
    return r.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+{r.randrange(20, 99)} {a} {b}{c}", f"00{r.randrange(20, 99)} {a} {b}{c}", f"0{a} / {b}{c}", f"+{r.randrange(20, 99)}/{a}/{b}{c}", f"+{r.randrange(20, 99)}.{a}.{b}.{c}"])


def _other(r: random.Random, kind: str) -> str:
    n = r.randrange
    return {
        "w": lambda: _word(r),
        "date": lambda: r.choice([f"{n(1900, 2030)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2030)}", f"{n(1, 13)}/{n(1, 29)}/{n(1900, 2030)}", f"{n(1, 29)} May {n(1900, 2030)}"]),
        "time": lambda: r.choice([f"{n(24):02}:{n(60):02}", f"{n(24):02}:{n(60):02}:{n(60):02}", f"{n(1, 12)} pm"]),
        "price": lambda: r.choice([f"${n(1, 999)}.{n(100):02}", f"{n(1, 999)},{n(100):02} €", f"{n(1, 99)},{n(1000):03}.{n(100):02}"]),
        "order": lambda: r.choice([_digits(r, n(5, 12)), f"{_digits(r, 3)}-{_digits(r, 7)}-{_digits(r, 7)}", f"A{_digits(r, 6)}", f"{_digits(r, 4)}-{_digits(r, 4)}", f"{_digits(r, 2)}-{_digits(r, 5)}"]),
        "isbn": lambda: r.choice([f"978-{n(9)}-{_digits(r, 3)}-{_digits(r, 5)}-{n(9)}", f"{n(9)}-{_digits(r, 3)}-{_digits(r, 5)}-{n(9)}"]),
        "version": lambda: ".".join(str(n(30)) for _ in range(n(2, 4))),
        "range": lambda: f"{n(1, 400)}-{n(400, 2100)}",
        "number": lambda: str(n(10 ** n(1, 6))),
        "numbers": lambda: r.choice([" ", ", "]).join(str(n(100)) for _ in range(n(3, 9))),
        "long": lambda: next(x for x in iter(lambda: _digits(r, n(13, 20)), None) if not _luhn(x)),
        "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 32, 40, 64]))),
        "section": lambda: ".".join(str(n(1, 20)) for _ in range(n(2, 4))),
        "coordinates": lambda: f"{n(90)}.{_digits(r, 4)}, {n(180)}.{_digits(r, 4)}",
        "badip": lambda: ".".join(str(x) for x in r.sample([n(256), n(256), n(256, 999), n(256, 999)], 4)),
        "badcard": lambda: _card(r, good=False),
        "url": lambda: f"https://{r.choice(_HOSTS)}.{_plain(r)}.com/{n(2000, 2030)}/{n(100)}/{_plain(r)}",
        "score": lambda: r.choice([f"{n(9)}-{n(9)}", f"{n(9)}:{n(9)}", f"{n(100)}%"]),
        "year": lambda: str(n(1800, 2030)),
        "size": lambda: f"{n(1, 999)}{r.choice([' kg', 'mm', ' x ' + str(n(999)), ' MB', 'th', 'px'])}",
    }[kind]()


def labelled(sentences: list[str] = SENTENCES, copies: int = COPIES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]) rows."""
    r, makers, rows = random.Random(seed), {"email": _email, "ip": _ip, "card": _card, "phone": _phone}, []
    for sentence in sentences:
        for _ in range(copies):
            text, spans = "", []
            for part in re.split(r"(\{\w+\})", sentence):
                kind = part[1:-1] if part[:1] == "{" else ""
                value = makers[kind](r) if kind in makers else _other(r, kind) if kind else part
                if kind in makers:
                    spans.append((kind, len(text), len(text) + len(value)))
                text += value
            before, behind = _around(r), _around(r)
            before += " " if before else ""
            rows.append((before + text + " " + behind, [(kind, len(before) + start, len(before) + end) for kind, start, end in spans]))
    return rows
