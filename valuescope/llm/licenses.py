"""License scan by ordered signature rules (DataFrame functions only).

Rules are regexes over the words of a text (A-Z lower-cased, words joined by one
space). A rule runs only on texts that hold its keyword. A match becomes an
interval of word positions. Rules are ordered by priority; a match whose
interval lies inside that of a match of the same or a better priority is
suppressed. Base phrases are never suppressed and are all counted.

A null or empty text has no words: counts 0, positions null, labels empty, score
0. Rows are handled one by one, without a shuffle: repeated rows and null ids
are returned as they are; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and their labels (fixed by the contract).
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: family: (label, regex of the name, versions). Each gives a rule per form of FORMS and version.
FAMILIES = [
    ("apache", r"apache(?: software)?", ["1 0", "1 1", "2 0"]),
    ("mit", r"mit|expat", []),
    ("bsd-2-clause", r"bsd 2 clause|simplified bsd|freebsd", []),
    ("bsd-3-clause", r"bsd 3 clause|new bsd|modified bsd|revised bsd", []),
    ("bsd-4-clause", r"bsd 4 clause|original bsd", []),
    ("0bsd", r"0bsd|zero clause bsd", []),
    ("isc", r"isc", []),
    ("mpl", r"mpl|mozilla public", ["1 0", "1 1", "2 0"]),
    ("epl", r"epl|eclipse public", ["1 0", "2 0"]),
    ("cddl", r"cddl|common development and distribution", ["1 0", "1 1"]),
    ("gpl", r"gpl|gnu gpl|gnu general public", ["1", "2", "3", "2 0", "3 0"]),
    ("lgpl", r"lgpl|gnu lgpl|gnu lesser general public|gnu library general public", ["2", "2 1", "3", "3 0"]),
    ("agpl", r"agpl|gnu agpl|gnu affero general public|affero general public", ["1", "3", "3 0"]),
    ("fdl", r"gfdl|gnu fdl|gnu free documentation", ["1 1", "1 2", "1 3"]),
    ("artistic", r"artistic|perl artistic", ["1 0", "2 0"]),
    ("boost", r"boost(?: software)?|bsl", ["1 0"]),
    ("zlib", r"zlib(?: libpng)?", []),
    ("unlicense", r"unlicense", []),
    ("wtfpl", r"wtfpl", ["2"]),
    ("python", r"python software foundation|psf", ["2", "2 0"]),
    ("ruby", r"ruby", []),
    ("php", r"php", ["3 0", "3 01"]),
    ("ofl", r"sil open font|ofl", ["1 0", "1 1"]),
    ("eupl", r"eupl|european union public", ["1 0", "1 1", "1 2"]),
    ("afl", r"academic free", ["2 1", "3 0"]),
    ("osl", r"open software", ["2 1", "3 0"]),
    ("ms-pl", r"microsoft public|ms pl", []),
    ("ms-rl", r"microsoft reciprocal|ms rl", []),
    ("odbl", r"odbl|open database", ["1 0"]),
    ("odc-by", r"odc by|open data commons attribution", ["1 0"]),
    ("pddl", r"pddl|public domain dedication and", ["1 0"]),
    ("sspl", r"sspl|server side public", ["1"]),
    ("busl", r"busl|business source", ["1 1"]),
    ("elastic", r"elastic", ["2 0"]),
    ("cc0", r"cc0|creative commons zero", ["1 0"]),
    ("ecl", r"educational community", ["1 0", "2 0"]),
    ("upl", r"universal permissive", ["1 0"]),
    ("ncsa", r"university of illinois ncsa open source|ncsa", []),
    ("postgresql", r"postgresql", []),
    ("openssl", r"openssl", []),
]
#: (kind, priority, keyword, regex around the name N and version V). Lower priority wins.
FORMS = [
    ("notice", 1, "licen", r"(?:licensed|released|distributed|available|provided|published) (?:under|with|by) (?:the )?(?:terms of )?(?:the )?(?:N) (?:public )?licen[cs]e(?: v(?:ersion)? ?V| V)?"),
    ("named", 2, "licen", r"(?:N) (?:public )?licen[cs]e(?: v(?:ersion)? ?V| V)"),
    ("short", 2, "licen", r"licensed under (?:the )?(?:terms of )?(?:the )?(?:N)(?: v(?:ersion)? ?V| V)?"),
    ("plain", 3, "licen", r"(?:N) licen[cs]e"),
    ("spdx", 1, "spdx", r"spdx licen[cs]e identifier (?:N)(?: V)?(?: only| or later)?"),
    ("field", 2, "licen", r"licen[cs]e (?:type )?(?:is )?(?:the )?(?:N)(?: V)?"),
]
CC = ["cc by", "cc by sa", "cc by nd", "cc by nc", "cc by nc sa", "cc by nc nd"]
UNDER, LATER = r"(?:licensed|released|distributed|available|provided|published) under", r"(?: (?:only|or later|or any later version))?"
#: (label, priority, keyword, regex): short names without the word licence.
SHORT = [
    *[rule for k, v in (("gpl", "[123] 0|[123]"), ("lgpl", "2 1|[23] 0|[23]"), ("agpl", "[13] 0|[13]"))
      for rule in ((k, 2, k, rf"(?:{UNDER} (?:the )?)?(?:gnu )?{k} ?(?:version )?v? ?(?:{v}){LATER}"), (k, 2, k, rf"{UNDER} (?:the )?(?:gnu )?{k}"))],
    ("cc0", 2, "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("apache", 2, "apache", r"apache 2 0|(?:(?<=mit )|(?<=mit or ))apache|apache(?= (?:or )?mit(?![^ ]))"),
    ("mit", 2, "apache", r"mit(?= (?:or )?apache(?![^ ]))|(?:(?<=apache )|(?<=apache or )|(?<=apache 2 0 )|(?<=apache 2 0 or ))mit"),
    ("mit", 2, "mit licensed", r"mit licensed"),
    ("bsd", 2, "bsd licen", rf"(?:{UNDER} (?:the |a )?)?bsd licen(?:[cs]e|sed)"),
    *[(label, 2, "clause", rf"(?:{UNDER} (?:the )?)?bsd {n} clause") for label, n in (("bsd-2-clause", "2"), ("bsd-3-clause", "3"), ("bsd-4-clause", "4"), ("0bsd", "zero"))],
    *[(label, 2, f"under {the}{name}", rf"{UNDER} {the}{name}(?: 2 0)?") for label, name in (("mit", "mit"), ("apache", "apache"), ("mpl", "mpl")) for the in ("the ", "")],
]
#: (label, priority, keyword, regex): rules written one by one.
SINGLE = [
    *[(c.replace(" ", "-"), 2, "cc", rf"{c}(?: (?:1 0|2 0|2 5|3 0|4 0))?") for c in CC],
    *[(c.replace(" ", "-"), 1, "creative commons", "creative commons " + " ".join({"cc": "", "by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}[p] for p in c.split()).strip() + "(?: (?:1 0|2 0|2 5|3 0|4 0))?(?: international)?") for c in CC],
    *[(c.replace(" ", "-"), 1, "creativecommons", rf"creativecommons org licenses {c[3:]}(?: [1-4] [05])?") for c in CC],
    ("cc0", 1, "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", 3, "public domain", r"(?:released|placed|dedicated)? ?(?:in|into|to)? ?(?:the )?public domain"),
    ("copyright", 4, "copyright", r"copyright(?: c)?(?: [12][0-9]{3})+"),
    ("copyright", 4, "rights", r"no rights reserved|some rights reserved"),
    ("proprietary", 3, "proprietary", r"(?:proprietary and )?confidential(?: and proprietary)?|proprietary licen[cs]e"),
    ("mit", 1, "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 1, "permission to use", r"permission to use copy modify and or distribute this software"),
    ("bsd", 1, "redistribution", r"redistribution and use in source and binary forms with or without modification"),
    ("apache", 1, "apache", r"apache org licenses license 2 0"),
    ("gpl", 1, "gnu", r"gnu org licenses (?:old licenses )?gpl(?: [23] 0)?"),
    ("lgpl", 1, "gnu", r"gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?"),
    ("agpl", 1, "gnu", r"gnu org licenses agpl(?: 3 0)?"),
    ("gpl", 1, "redistribute it", r"redistribute it and or modify it under the terms of the gnu general public license"),
    ("unlicense", 1, "unencumbered", r"free and unencumbered software released into the public domain"),
    ("warranty", 5, "warrant", r"(?:provided )?as is without warranty(?: of any kind)?|without any warranty"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    regex: str


def rules() -> list[Rule]:
    """All rules in order; a base phrase has priority 0."""
    out = [Rule(label, 0, phrase.split()[0], phrase) for phrase, label in BASE]
    for label, name, versions in FAMILIES:
        for _, priority, keyword, form in FORMS:
            v = "|".join(versions) or r"[0-9](?: [0-9])?"
            out.append(Rule(label, priority, keyword, form.replace("N", name).replace("V", f"(?:{v})")))
    return out + [Rule(*r) for r in SHORT + SINGLE]


CONFIDENCE = {0: 0.9, 1: 0.95, 2: 0.9, 3: 0.7, 4: 0.4, 5: 0.2}


def hits(norm: Column, low: Column) -> Column:
    """Array of (start, stop, priority, label): the places where a rule's regex matches whole words."""
    by_key: dict[str, list[Rule]] = {}
    for r in rules():
        by_key.setdefault(r.keyword, []).append(r)
    parts = []
    for key, some in by_key.items():
        table = F.array(*[F.struct(F.lit(r.priority).alias("p"), F.lit(r.label).alias("l"),
                                   F.lit(rf"(?<![^ ])(?:{r.regex})(?![^ ])").alias("re")) for r in some])

        def found(r):
            texts = F.regexp_extract_all(norm, r["re"], F.lit(0))
            gaps = F.split(norm, r["re"], -1)
            n_gap = F.transform(gaps, lambda g: spaces(g))
            n_text = F.transform(texts, lambda t: spaces(t))
            first = F.transform(texts, lambda t, k: F.aggregate(F.slice(n_gap, 1, k + 1), F.lit(0), lambda a, x: a + x)
                                + F.aggregate(F.slice(n_text, 1, k), F.lit(0), lambda a, x: a + x))
            return F.transform(texts, lambda t, k: F.struct(F.get(first, k).alias("start"), (F.get(first, k) + F.get(n_text, k) + 1).alias("stop"),
                                                            r["p"].alias("p"), r["l"].alias("l")))

        none = F.array().cast("array<struct<start:int,stop:int,p:int,l:string>>")
        live = F.filter(table, lambda r: F.regexp_like(norm, r["re"]))
        parts.append(F.when(F.contains(low, F.lit(key)), F.flatten(F.transform(live, found))).otherwise(none))
    return F.concat(*parts)


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_hits, n_kept: one row per row."""
    d = docs.select(docs[id_col].cast("long").alias("doc_id"),
                    F.trim(F.regexp_replace(F.coalesce(docs[text_col].cast("string"), F.lit("")), BREAKS, " ")).alias("w"))
    d = d.select("doc_id", F.when(F.col("w") == "", 0).otherwise(spaces(F.col("w")) + 1).cast("long").alias("n_words"), "w",
                 F.lower("w").alias("low"))
    keys = sorted({r.keyword for r in rules()} - {"cc"})
    gate = F.col("low").rlike("(?<![^ ])cc by(?![^ ])")
    for k in keys:
        gate = gate | F.contains("low", F.lit(k))
    norm = F.when(gate, F.translate("w", UPPER, LOWER))
    d = d.select("doc_id", "n_words", norm.alias("norm"), F.when(gate, F.col("low")).alias("low"))
    d = d.withColumn("hits", F.when(F.col("norm").isNotNull(), F.array_sort(hits(F.col("norm"), F.col("low")), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["stop"] != b["stop"], b["stop"] - a["stop"]).otherwise(a["p"] - b["p"]))))
    levels = sorted(CONFIDENCE)
    # best[p]: largest stop so far of a match with priority p or better; sorted by start, a later match lies inside one of them if its stop is no larger
    init = F.struct(F.array(*[F.lit(-1)] * len(levels)).alias("best"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("kept"))

    def step(s, h):
        inside = (h["p"] > 0) & (F.get(s["best"], h["p"]) >= h["stop"])
        best = F.transform(s["best"], lambda b, k: F.when((~inside) & (k >= h["p"]), F.greatest(b, h["stop"])).otherwise(b))
        mark = F.concat(h["p"].cast("string"), F.lit(":"), h["l"])
        return F.struct(best.alias("best"), F.when(inside, s["labels"]).otherwise(F.array_union(s["labels"], F.array(mark))).alias("labels"),
                        (s["kept"] + F.when(inside, 0).otherwise(1)).alias("kept"))

    d = d.withColumn("base", F.filter("hits", lambda h: h["p"] == 0)).withColumn("run", F.aggregate("hits", init, step))
    names = F.transform(F.col("run.labels"), lambda m: F.substring_index(m, ":", -1))
    conf = F.create_map(*[x for p in levels for x in (F.lit(str(p)), F.lit(CONFIDENCE[p]))])
    score = 1.0 - F.aggregate(F.col("run.labels"), F.lit(1.0), lambda a, m: a * (1.0 - conf[F.substring_index(m, ":", 1)]))
    joined = lambda a: F.coalesce(F.array_join(F.array_sort(F.array_distinct(a)), ","), F.lit(""))
    return d.select("doc_id", "n_words", F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
                    F.array_min(F.transform("base", lambda h: h["start"])).cast("long").alias("first_word"),
                    F.array_max(F.transform("base", lambda h: h["start"])).cast("long").alias("last_word"),
                    joined(F.transform("base", lambda h: h["l"])).alias("base_labels"), joined(names).alias("labels"),
                    F.coalesce(score, F.lit(0.0)).alias("score"),
                    F.when(F.col("hits").isNull(), 0).otherwise(F.size("hits")).cast("long").alias("n_hits"),
                    F.coalesce(F.col("run.kept"), F.lit(0)).cast("long").alias("n_kept"))
