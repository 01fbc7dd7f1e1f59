"""License scans by ordered signature rules.

A few hundred regexes over a text's words, written by hand (module `signatures`: sentences of license texts, addresses,
notices, identifiers), and the names under which licenses are mentioned. Texts without a keyword of the gate are let
through at once; in the others, each rule is tried only where its own keyword, which all its texts hold, stands. Detections are intervals
of words. Where intervals overlap, priority and containment decide: a detection within another of at least its priority
is suppressed, and so is one that a higher priority overlaps. DataFrame functions only.

Words are lower-cased (A-Z) runs of digits, letters and anything beyond ASCII. Base phrases are found everywhere and
are never suppressed.

Defined results: a null or blank text has no words, no places, empty labels and score 0; null ids are ids like others;
equal rows get equal results; an empty table gives no rows; other columns are ignored. Score: 1 for a detected license
text or identifier, 0.9 for a base phrase or a named license, 0.5 for a loose mention, 0 for none; the best counts.
"""

from __future__ import annotations

import json
import re
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import signatures
from .common import let

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, names as words, versions as words. Names hold the keyword that gates them as their first word.
FAMILIES = [
    ("mit", ["mit"], []),
    ("apache", ["apache", "apache software"], ["1 0", "1 1", "2 0"]),
    ("gpl", ["gnu general public", "gpl", "gnu gpl"], ["1", "2", "3", "2 0", "3 0"]),
    ("lgpl", ["gnu lesser general public", "gnu library general public", "lgpl", "gnu lgpl"], ["2", "2 1", "3", "3 0"]),
    ("agpl", ["gnu affero general public", "affero general public", "agpl"], ["1", "3", "3 0"]),
    ("bsd", ["bsd", "new bsd", "simplified bsd", "revised bsd", "modified bsd"], ["2 clause", "3 clause", "4 clause"]),
    ("mpl", ["mozilla public", "mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public", "epl"], ["1 0", "2 0"]),
    ("cddl", ["common development and distribution", "cddl"], ["1 0", "1 1"]),
    ("cpl", ["common public", "cpl"], ["1 0"]),
    ("isc", ["isc"], []),
    ("zlib", ["zlib", "zlib libpng"], []),
    ("boost", ["boost software", "bsl"], ["1 0"]),
    ("artistic", ["artistic", "perl artistic"], ["1 0", "2 0"]),
    ("eupl", ["european union public", "eupl"], ["1 0", "1 1", "1 2"]),
    ("unlicense", ["unlicense"], []),
    ("wtfpl", ["wtfpl", "do what the fuck you want to public"], ["2"]),
    ("python", ["python software foundation", "psf"], ["2", "2 0"]),
    ("php", ["php"], ["3 0", "3 01"]),
    ("openssl", ["openssl"], []),
    ("postgresql", ["postgresql"], []),
    ("ofl", ["sil open font", "ofl"], ["1 0", "1 1"]),
    ("cc0", ["cc0", "creative commons zero", "creative commons cc0"], ["1 0"]),
    ("cc-by", ["cc by", "creative commons attribution"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-sa", ["cc by nc sa", "creative commons attribution noncommercial sharealike"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", ["cc by nc nd", "creative commons attribution noncommercial noderivatives"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("odbl", ["open database", "odbl"], ["1 0"]),
    ("w3c", ["w3c software", "w3c"], []),
    ("ms-pl", ["microsoft public", "ms pl"], []),
    ("ibm", ["ibm public"], ["1 0"]),
    ("qpl", ["q public", "qpl"], ["1 0"]),
    ("ncsa", ["university of illinois ncsa open source", "ncsa"], []),
    ("afl", ["academic free", "afl"], ["2 1", "3 0"]),
    ("osl", ["open software", "osl"], ["1 0", "2 1", "3 0"]),
    ("sspl", ["server side public", "sspl"], ["1"]),
    ("elastic", ["elastic"], ["2 0"]),
    ("busl", ["business source", "busl"], ["1 1"]),
]
#: Names that mean a license without the word license.
ACRONYMS = ["gpl", "gnu gpl", "lgpl", "gnu lgpl", "agpl", "mpl", "epl", "cddl", "eupl", "ofl", "odbl", "sspl", "wtfpl", "cc0", "cc by", "cc by sa", "cc by nd", "cc by nc", "cc by nc sa", "cc by nc nd"]
#: Phrasings with {name} and {version} by which texts mention a license; priority; score. The last is for acronyms only.
PHRASINGS = [
    ("licensed under (?:the |a |an )?(?:terms of the )?{name}(?: licen[cs]e)?{version}", 3, 0.9),
    ("{name} licen[cs]e{version}", 2, 0.9),
    ("{name} licensed{version}", 1, 0.5),
    ("{name}{version}", 1, 0.9),
]
#: How identifiers go on.
SUFFIX = "(?: only| or later)?(?: with (?:classpath exception 2 0|llvm exception|gcc exception (?:2 0|3 1)|linux syscall note|openssl exception|bison exception 2 2|font exception 2 0|autoconf exception (?:2|3) 0))?"
_SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Parts of words, and starts of words, one of which every text of a rule holds; `rules` fails for a rule whose texts don't.
GATE = [
    "licen", "software", "permission", "distribut", "copyright", "warrant", "proprietary", "confidential", "gpl", "cc0", "public domain", "rights reserved", "droits réservés", "rechte vorbehalten", "derechos reservados",
    "trademark", "prohibited", "commercial", "evaluation purposes", "use only", "reproduced", "fuck you", "advertising", "trade secrets", "restriction", "and not evil", "dedication", "misrepresented",
    "perl", "bsl11", "beer in return", "derivative work", "combined work", "prominently offer", "package may be copied", "ports to new operating systems", "gemma", "copyleft", "eupl",
    "latex project", "creativecommons", "contributors may", "openssl", "available to third parties",
]
GATE_WORDS = ["mpl", "epl", "cddl", "eupl", "ofl", "odbl", "sspl", "wtfpl", "cc by"]


def variants(regex: str) -> list[str]:
    """The texts that a rule's regex matches, with an ellipsis for each gap: all choices of its groups, classes and optional letters."""
    done, left = [], [re.sub(r"\.\{\d+,\d+\}\?", "…", regex)]
    group, letter = re.compile(r"\(\?:([^()]*)\)(\?)?"), re.compile(r"(?:\[([^\]]+)\]|([^\]?]))(\?)?")
    while left:
        r = left.pop()
        if m := group.search(r):
            left += [r[: m.start()] + x + r[m.end() :] for x in [*m[1].split("|"), *[""] * bool(m[2])]]
            continue
        m = next((m for m in letter.finditer(r) if m[1] or m[3]), None)
        if m:
            left += [r[: m.start()] + x + r[m.end() :] for x in [*(m[1] or m[2]), *[""] * bool(m[3])]]
        else:
            done.append(r)
    return done


def _opens(text: str) -> bool:
    return any(w in text for w in GATE) or any(" " + w in " " + text for w in GATE_WORDS)


def _keyword(texts: list[str]) -> str:
    """The longest word that all of a rule's texts hold; the empty one if they have none in common."""
    common = set.intersection(*({w for w in t.split() if "…" not in w} for t in texts))
    return max(common, key=lambda w: (len(w), w), default="")


@cache
def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword that the text must hold, regex over space-joined words, priority, score), in order."""
    out = []
    for label, names, versions in FAMILIES:
        any_version = "(?: version)? ?v?(?:" + "|".join(sorted(versions, key=len, reverse=True)) + ")"
        for phrase, priority, score in PHRASINGS:
            for name in names:
                if phrase != "{name}{version}" or name in ACRONYMS:
                    if versions:
                        out.append((label, name, phrase.replace("{name}", name).replace("{version}", any_version), priority + 2, score))
                    out.append((label, name, phrase.replace("{name}", name).replace("{version}", ""), priority, score))
    for label, priority, score, regex in signatures.TEXTS + signatures.ADDRESSES + signatures.NOTICES:
        texts = variants(regex)
        if shut := [t for t in texts if not _opens(t)]:
            raise ValueError(f"no part of {shut[0]!r} is in the gate")
        out.append((label, _keyword(texts), regex, priority, score))
    # longer identifiers come first where one starts with another, by containment
    out += [(i.replace(" ", "-"), "spdx", f"spdx license identifier {i}{SUFFIX}", 6, 1.0) for i in signatures.IDENTIFIERS]
    return out


def _places(line: Column, regex: str | Column) -> Column:
    """Array of (start, end) in words of the regex's matches in " word word ... ", from the pieces between them."""
    r = regex if isinstance(regex, Column) else F.lit(regex)
    blanks = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))
    pieces, found = F.split(line, r, -1), F.regexp_extract_all(line, r, F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    # the line starts with a blank, and a match starts after one: the blanks before it, less one, are its first word
    step = lambda a, p: let(a["at"] + blanks(p["gap"]), lambda at: F.struct((at + blanks(p["hit"])).alias("at"), F.array_append(a["out"], F.struct((at - 1).cast("int").alias("start"), (at + blanks(p["hit"])).cast("int").alias("end"))).alias("out")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]


def _bounded(regex: str) -> str:
    return rf"(?<= ){regex}(?= )"


def _line(text: Column) -> Column:
    """ " word word ... " of the lower-cased words."""
    upper = "".join(map(chr, range(0x41, 0x5B)))
    words = F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(WORD), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _detections(line: Column) -> Column:
    """Array of (start, last, priority, rule's place, label, score), sorted: longer first where they start together."""
    by_keyword: dict[str, list[dict]] = {}
    for k, (label, keyword, regex, priority, score) in enumerate(rules()):
        by_keyword.setdefault(" " + keyword, []).append({"label": label, "regex": _bounded(regex), "priority": priority, "score": score, "nth": k})
    table = F.from_json(F.lit(json.dumps([{"keyword": k, "rules": r} for k, r in by_keyword.items()])), "array<struct<keyword:string,rules:array<struct<label:string,regex:string,priority:int,score:double,nth:int>>>>")
    # a keyword starts with a blank: the start of a word
    tried = F.flatten(F.transform(F.filter(table, lambda r: F.contains(line, r["keyword"])), lambda r: r["rules"]))
    each = F.transform(tried, lambda r: F.transform(_places(line, r["regex"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("minus_end"), (-r["priority"]).alias("minus_priority"), r["nth"].alias("nth"), r["label"].alias("label"), r["score"].alias("score"))))
    return F.sort_array(F.flatten(each))


def _kept(found: Column) -> Column:
    """The detections by priority, highest first: of one priority those that no kept one of a higher priority overlaps, without those that another of these contains. What isn't kept suppresses nothing."""
    end, none = (lambda d: -d["minus_end"]), F.array().cast("array<boolean>")

    def walk(both: Column, least: Column, reach, beyond, start: int) -> Column:
        """Whether each of `both` is beyond the reach of those of a higher priority that come before it."""
        step = lambda a, d: F.struct(F.when(d["minus_priority"] < least, reach(a["at"], d)).otherwise(a["at"]).alias("at"), F.array_append(a["out"], beyond(a["at"], d)).alias("out"))
        return F.aggregate(both, F.struct(F.lit(start).alias("at"), none.alias("out")), step)["out"]

    def level(kept: Column, least: Column) -> Column:
        """kept with the detections of a priority, of which `least` is the negative."""
        both = F.sort_array(F.concat(kept, F.filter(found, lambda d: d["minus_priority"] == least)))

        def free(both: Column) -> Column:
            before = walk(both, least, lambda at, d: F.greatest(at, end(d)), lambda at, d: at <= d["start"], -1)
            after = walk(F.reverse(both), least, lambda at, d: F.least(at, d["start"]), lambda at, d: at >= end(d), 2**31 - 1)
            return let(before, lambda x: let(F.reverse(after), lambda y: F.filter(both, lambda d, k: (d["minus_priority"] == least) & F.get(x, k) & F.get(y, k))))

        def outer(own: Column) -> Column:
            step = lambda a, d: F.struct(F.greatest(a["at"], end(d)).alias("at"), F.array_append(a["out"], a["at"] < end(d)).alias("out"))
            return let(F.aggregate(own, F.struct(F.lit(-1).alias("at"), none.alias("out")), step)["out"], lambda x: F.filter(own, lambda d, k: F.get(x, k)))

        return F.concat(kept, let(let(both, free), outer))

    levels = F.array_sort(F.array_distinct(F.transform(found, lambda d: d["minus_priority"])))
    return F.sort_array(F.aggregate(levels, F.filter(found, lambda d: F.lit(False)), level))


def _n_words(text: Column) -> Column:
    """The pieces between separators, less the empty ones that a separator at either end leaves."""
    edge = lambda c: F.rlike(c, F.lit(_SEP)).cast("int")
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, _SEP, -1)) - edge(F.left(text, F.lit(1))) - edge(F.right(text, F.lit(1)))).cast("long")


def _gate(text: Column) -> Column:
    """Whether the text holds a keyword. Plain searches come first; a regex looks at texts that hold a short word's letters."""

    def opened(low: Column) -> Column:
        has = lambda w: F.rlike(low, F.lit(w.replace(" ", _SEP))) if " " in w else F.lit(True)
        part = [F.contains(low, F.lit(w.split()[0])) & has(w) for w in GATE]
        whole = [F.contains(low, F.lit(w.split()[0])) & F.rlike(low, F.lit(rf"(?:^|{_SEP})" + w.replace(" ", _SEP))) for w in GATE_WORDS]
        return reduce(Column.__or__, part + whole)

    return let(F.lower(text), opened)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (array of (start, end, label) of the base phrases), found (array of the kept detections)."""
    def places(line: Column, phrase: str) -> Column:
        return F.transform(_places(line, _bounded(phrase)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(BASE[phrase]).alias("label")))

    base = lambda line: F.flatten(F.array(*[places(line, p) for p in BASE]))
    scan = let(_line(F.col("text")), lambda line: F.struct(base(line).alias("base"), let(_detections(line), _kept).alias("found")))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", _n_words(F.col("text")).alias("n_words"), F.when(_gate(F.col("text")), scan).alias("s")).select("doc_id", "n_words", "s.base", "s.found")


def license_report(docs: DataFrame) -> DataFrame:
    pick = lambda c, f: F.transform(c, lambda x: x[f])
    none = F.array().cast("array<string>")
    base_labels, found_labels = F.coalesce(pick("base", "label"), none), F.coalesce(pick("found", "label"), none)
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.greatest(F.coalesce(F.array_max(pick("found", "score")), F.lit(0.0)), F.when(F.size("base") > 0, 0.9).otherwise(0.0))
    return license_scan(docs).select(
        "doc_id", "n_words", F.size(base_labels).cast("long").alias("n_base"),
        F.array_min(pick("base", "start")).cast("long").alias("first_word"), F.array_max(pick("base", "start")).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, found_labels)).alias("labels"), score.alias("score"),
    )
