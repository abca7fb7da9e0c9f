"""What a text shows on its surface, token by token: the rules of its terms in plain Python, for tasks that read a text once."""

from __future__ import annotations

import re
import unicodedata

from ..functions import korean as K

# Quotation marks, quoted passages, what is between tokens, and the form of an organisation's stem.
QUOTES = "[\"“”'‘’『』「」《》〈〉]"
QUOTED = rf"{QUOTES}([^\"“”'‘’『』「」《》〈〉\r\n]{{2,80}}){QUOTES}"

_any = lambda words: "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"
_PARTS, _QUOTED, _HANGUL = re.compile("([가-힣A-Za-z0-9_-]+)"), re.compile(QUOTED), re.compile("[가-힣]")
_OTHER, _TOKEN = re.compile("[^가-힣a-z0-9]+"), re.compile("[가-힣A-Za-z0-9_-]+")
_STEM, _NAME = re.compile("[가-힣a-z0-9_-]{2,20}"), re.compile("[가-힣]{2,4}")
_SPACED = re.compile(r"[\t\u0020\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]+")
_SURNAME, _LATIN = re.compile(f"[{K.SURNAMES}][가-힣]{{1,3}}"), re.compile(K.LATIN)
_ENDING = {least: re.compile(f"(.{{{least},}}?){_any(K.ENDINGS)}") for least in (1, 2)}
_HONORED = re.compile(f"(.+?){_any(K.HONORIFICS)}")
_ATTACHED = re.compile(f"([가-힣]{{2,4}}?){_any([*K.ROLES, *K.HONORIFICS])}")
_ORGANIZED = re.compile(f"(.*?)({_any(K.ORGANIZATIONS)})")
_ROLES, _ORGANIZATIONS, _ATTRIBUTIONS, _ONTOLOGY = {*K.ROLES, *K.HONORIFICS}, set(K.ORGANIZATIONS), set(K.ATTRIBUTIONS), set(K.ONTOLOGY)


def composed(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def normal(text: str) -> str:
    """T.surface_norm of a text in NFC."""
    return _OTHER.sub("", text.lower())


def tokens(text: str) -> list[str]:
    """T.surface_tokens of a text in NFC."""
    return _TOKEN.findall(text.lower())


def runs(listed: list[str], size: int) -> set[tuple[str, ...]]:
    """Runs of `size` tokens."""
    return set(zip(*[listed[i:] for i in range(size)]))


def _surname(base: str) -> bool:
    return _SURNAME.fullmatch(base) is not None and base not in _ONTOLOGY


def _without(pattern: re.Pattern, word: str) -> str:
    found = pattern.fullmatch(word)
    return found[1] if found else word


class Surface:
    """The terms of texts. What a token gives by itself is derived once and kept, for `most` tokens.

    `asked` tells for a kind under which names, and whether only among some terms, it is given; without it all terms are.
    """

    def __init__(self, most: int, asked: dict[str, list[tuple[str, set[str] | None]]] | None = None):
        self.most, self.asked, self.kept, self.form = most, asked, {}, ""

    def _asked(self, found) -> tuple:
        if self.asked is None:
            return tuple({x for x in found if x[1]})
        return tuple({(name, term) for kind, term in found if term for name, terms in self.asked.get(kind, ()) if terms is None or term in terms})

    def token(self, raw: str) -> tuple[tuple, str, bool, bool]:
        """A token's own terms, base, and whether it has Hangul and is a role."""
        known = self.kept.get(raw)
        if known is None:
            if len(self.kept) >= self.most:
                self.kept.clear()
            known = self.kept[raw] = self._derived(raw)
        return known

    def _derived(self, raw: str) -> tuple[tuple, str, bool, bool]:
        form = raw.lower().replace("_", "").replace("-", "")
        if not _HANGUL.search(raw):
            return self._asked([("exact", form)] * (len(form) >= 2) + [("latin", form)] * (_LATIN.fullmatch(raw) is not None)), form, False, False
        base = _without(_ENDING[2], form)
        found = [("exact", base)] * (len(base) >= 2)
        attached, organized = _ATTACHED.fullmatch(base), _ORGANIZED.fullmatch(base)
        if attached:
            found += [("anchored", attached[1]), ("person", attached[1])]
        found += [("surname", x) for x in (base, base[:-1] if base.endswith("이") else "") if _surname(x)]
        if organized and _STEM.fullmatch(organized[1]):
            found += [("org_stem", organized[1]), ("org_full", base), ("exact", base)]
        if form != base and form.endswith("의") and _STEM.fullmatch(base):
            found.append(("attribution", base))
        return self._asked(found), base, True, _without(_HONORED, _without(_ENDING[1], form)) in _ROLES

    def terms(self, text: str) -> set[tuple[str, str]]:
        """kind and term of a text in NFC, whose normal form is kept: terms of tokens, of tokens beside a role, an organisation or an attribution, quoted ones."""
        parts = _PARTS.split(text)
        listed, found, near = parts[1::2], set(), []
        # Of what is between tokens only a dotted capital I gives a letter in lower case.
        self.form = normal(text) if "İ" in text else "".join(listed).lower().replace("_", "").replace("-", "")
        marks = {}
        for raw in set(listed):
            own, base, hangul, role = self.token(raw)
            found.update(own)
            if hangul and (role or base in _ORGANIZATIONS or base in _ATTRIBUTIONS):
                marks[raw] = role, base if base in _ORGANIZATIONS or base in _ATTRIBUTIONS else None
        if marks:
            beside, led = set(), set()
            for i, raw in enumerate(listed):
                if raw not in marks:
                    continue
                role, following = marks[raw]
                if role:
                    beside.update(listed[max(i - 1, 0) : i])
                    beside.update(listed[i + 1 : i + 2])
                if following and i and (parts[2 * i] == " " or _SPACED.fullmatch(parts[2 * i])):
                    led.add((listed[i - 1], following))
            for raw in beside:
                _, base, hangul, _ = self.token(raw)
                if hangul and _NAME.fullmatch(base) and _surname(base):
                    near.append(("person", base))
            for raw, following in led:
                base = self.token(raw)[1]
                if _STEM.fullmatch(base):
                    near += [("org_stem", base), ("org_full", base + following), ("exact", base + following)] if following in _ORGANIZATIONS else [("attribution", base)]
        if self.asked is None or "quoted" in self.asked:
            quoted = [normal(x) for x in _QUOTED.findall(text)]
            near += [("quoted", x) for x in quoted if len(x) >= 2]
        found.update(self._asked(near))
        return found
