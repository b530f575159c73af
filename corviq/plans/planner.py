"""Query expansion by a language model behind an interface, and the tier of a question."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corviq.errors import EngineError

MAX_TERMS, MAX_TERM, MAX_HINT, MAX_QUESTION, MAX_TOKENS = 32, 128, 256, 2_000, 256
DENSE_PREFIX = "search_query: "

#: A client takes a prompt and returns the model's answer; none is bundled.
Client = Callable[[str], str]


@dataclass(frozen=True)
class Expansion:
    """What a model makes of a question. Hints are soft: they boost, they never filter."""

    search_terms: tuple[str, ...]
    path_hint: str | None = None
    kind_hint: str | None = None
    mode_hint: str | None = None

    def dense_text(self) -> str:
        return DENSE_PREFIX + " ".join(self.search_terms)

    def sparse_text(self, question: str) -> str:
        return " ".join([question, *self.search_terms])

    def boosts(self, columns: Sequence[str], amount: float = 0.01) -> list[tuple[str, str, str, float]]:
        out = []
        if self.path_hint and "path" in columns:
            out.append(("path", "contains", self.path_hint, amount))
        if self.kind_hint and "kind" in columns:
            out.append(("kind", "equals", self.kind_hint, amount))
        return out


def _control(text: str) -> bool:
    return any(unicodedata.category(c) == "Cc" for c in text)


def sanitize(question: str) -> str:
    """Without control characters, trimmed. An empty question or one of more than ``MAX_QUESTION`` characters is refused."""
    out = "".join(c for c in question if not _control(c)).strip()
    if not out:
        raise EngineError("22000", "the question is empty")
    if len(out) > MAX_QUESTION:
        raise EngineError("54000", f"the question has more than {MAX_QUESTION} characters")
    return out


def prompt(question: str, symbols: Sequence[str] = (), terms: Sequence[str] = ()) -> str:
    """The dictionary of the corpus (symbols and its top terms), then the question, with the form of the answer."""
    return (
        f"Known symbols: {', '.join(symbols)}\nFrequent terms: {', '.join(terms)}\n"
        'Answer with one JSON object {"search_terms": [...], "path_hint": text or null, "kind_hint": text or null, "mode": "recall" or "precision" or null}.\n'
        f"Question: {sanitize(question)}"
    )


def parse_expansion(answer: str) -> Expansion:
    """The first JSON object of the answer. Terms are up to 32 texts of 128 characters, both hints are there (null or a
    text of 256), control characters are refused; a mode that isn't one counts as none."""
    try:
        found, _ = json.JSONDecoder().raw_decode(answer, answer.index("{"))
    except ValueError:
        raise EngineError("22000", "the planner's answer has no JSON object") from None
    terms = found.get("search_terms")
    if not isinstance(terms, list) or len(terms) > MAX_TERMS or not all(isinstance(t, str) and len(t) <= MAX_TERM and not _control(t) for t in terms):
        raise EngineError("22000", f"search_terms is a list of up to {MAX_TERMS} texts of up to {MAX_TERM} characters")
    hints = {}
    for name in ("path_hint", "kind_hint"):
        hint = found.get(name, False)
        if hint is not None and (not isinstance(hint, str) or len(hint) > MAX_HINT or _control(hint)):
            raise EngineError("22000", f"{name} is null or a text of up to {MAX_HINT} characters")
        hints[name] = hint
    mode = found.get("mode")
    return Expansion(tuple(terms), **hints, mode_hint=mode if mode in ("recall", "precision") else None)


# -- tiers -----------------------------------------------------------------------------------------------------------

# Cue words, extensions, punctuation and short forms.
CUES = ("why", "how", "what", "explain", "overview", "architecture", "design", "concept", "概要", "設計", "なぜ", "理由", "とは", "仕組み")
EXTENSIONS = ("rs", "toml", "md", "yml", "yaml", "json", "txt")
EDGES = "?!,;:'\"`()[]{}<>、。！？「」『』"
SHORT_FORMS = ("n't", "'re", "'ve", "'ll", "'s", "'d", "'m")

#: What a class of questions is handled by: looking something up is dialogue, everything else needs high precision.
TIERS = {"direct": "dialogue", "intent": "high_precision", "abstraction": "high_precision"}


def _lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def question_tokens(question: str) -> list[str]:
    """Words between white space, without punctuation at their edges (a dot only at the end) and without short forms."""
    out = []
    for word in question.split():
        if _control(word):
            continue
        word = _lower(word.lstrip(EDGES).rstrip(EDGES + "."))
        short = next((s for s in SHORT_FORMS if word.endswith(s) and len(word) > len(s)), "")
        if word := word.removesuffix(short):
            out.append(word)
    return out


def classify(question: str, paths: Collection[str] = (), symbols: Collection[str] = (), cues: Collection[str] = CUES, extensions: Collection[str] = EXTENSIONS) -> tuple[str, str]:
    """(direct, intent or abstraction; why: path, cue, symbol, none or degenerate), in this order:

    a word that is a path of the dictionary or ends in a known extension is direct; a cue word (a word in ASCII, any
    part of the question in other scripts) is abstraction; a symbol of the dictionary is direct; the rest is intent, and
    so are, to be on the safe side, empty questions and those beyond 2000 characters or 256 words.
    """
    if not question.strip() or len(question) > MAX_QUESTION or len(question.split()) > MAX_TOKENS or not (words := question_tokens(question)):
        return "intent", "degenerate"
    known, ends = {_lower(p) for p in paths}, {_lower(e) for e in extensions}
    if any(w in known or "." in w and w.rpartition(".")[2] in ends for w in words):
        return "direct", "path"
    whole = _lower(question)
    if any(c in words if c.isascii() else c in whole for c in map(_lower, cues)):
        return "abstraction", "cue"
    named = {_lower(s) for s in symbols}
    return ("direct", "symbol") if any(w in named for w in words) else ("intent", "none")


def tier(question: str, paths: Collection[str] = (), symbols: Collection[str] = ()) -> tuple[str, str]:
    """(direct, intent or abstraction; the handling that fits: dialogue or high_precision)."""
    kind, _ = classify(question, paths, symbols)
    return kind, TIERS[kind]


def class_column(question: Column, paths: Collection[str] = (), symbols: Collection[str] = ()) -> Column:
    """:func:`classify` as built-in functions; ``paths`` and ``symbols`` are lists that travel with the plan."""
    def low(c: Column) -> Column:
        return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    edge = "".join(re.escape(c) for c in EDGES)
    raw = F.filter(F.split(question, r"(?U)\s+"), lambda w: w != "")
    bare = F.transform(F.filter(raw, lambda w: ~w.rlike(r"\p{Cc}")), lambda w: low(F.regexp_replace(F.regexp_replace(w, f"^[{edge}]+", ""), f"[{edge}.]+$", "")))
    words = F.filter(F.transform(bare, lambda w: F.regexp_replace(w, f"(?<=.)(?:{'|'.join(SHORT_FORMS)})$", "")), lambda w: w != "")

    def among(values: Collection[str]) -> Column:
        listed = [F.lit(_lower(v)) for v in values]
        return F.arrays_overlap(words, F.array(*listed)) if listed else F.lit(False)

    other = [c for c in CUES if not c.isascii()]
    odd = (F.size(words) == 0) | (F.length(question) > MAX_QUESTION) | (F.size(raw) > MAX_TOKENS)
    cue = among([c for c in CUES if c.isascii()]) | low(question).rlike("|".join(map(re.escape, other)))
    path = among(paths) | F.exists(words, lambda w: w.rlike(rf"\.({'|'.join(EXTENSIONS)})$"))
    return F.when(question.isNull() | odd, "intent").when(path, "direct").when(cue, "abstraction").when(among(symbols), "direct").otherwise("intent")


def tier_column(kind: Column) -> Column:
    return F.when(kind == "direct", TIERS["direct"]).otherwise(TIERS["intent"])
