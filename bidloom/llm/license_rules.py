"""Signature rules of the licence scan: hand-written patterns, and those that follow from a licence's name.

A pattern reads words: `<mozilla>` is one whole word, and everything else is an
ordinary regular expression over such words. Every pattern begins with a plain
word; a rule is only tried where that word stands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: `v` and `version` before a number, and a trailing `.0`.
_V = "(?:<version>)?"
_0 = "(?:<0>)?"
_GNU_V = f"(?:{_V}<v?{{}}>{_0})"
_TERMS = "(?:<the>)?(?:<terms><of>(?:<the>)?|<conditions><of>(?:<the>)?)?"

#: Licence and the pattern of its full name.
NAMES = (
    ("0bsd", "<zero><clause><bsd>(?:<license>)?"),
    ("aal", "<attribution><assurance><license>"),
    ("afl-3.0", f"<academic><free><license>{_V}<v?3>{_0}"),
    ("agpl-3.0", f"<affero><general><public><license>{_GNU_V.format(3)}?"),
    ("apache-1.1", f"<apache>(?:<software>)?<licen[cs]e>{_V}<v?1><1>"),
    ("apache-2.0", f"<apache>(?:<software>)?<licen[cs]e>{_V}<v?2>{_0}"),
    ("artistic-1.0", f"<artistic><license>{_V}<v?1>{_0}"),
    ("artistic-2.0", f"<artistic><license>{_V}<v?2>{_0}"),
    ("bsd-1-clause", "<bsd><(?:1|one)><clause>(?:<license>)?"),
    ("bsd-2-clause", "<bsd><(?:2|two)><clause>(?:<license>)?"),
    ("bsd-3-clause", "<bsd><(?:3|three)><clause>(?:<license>)?"),
    ("bsd-4-clause", "<bsd><(?:4|four)><clause>(?:<license>)?"),
    ("bsl-1.0", f"<boost><software><license>(?:{_V}<v?1>{_0})?"),
    ("busl-1.1", f"<business><source><license>(?:{_V}<v?1><1>)?"),
    ("cc-by-2.0", "<creative><commons><attribution>(?:<generic>)?<2><0>"),
    ("cc-by-3.0", "<creative><commons><attribution>(?:<unported>)?<3><0>"),
    ("cc-by-4.0", "<creative><commons><attribution>(?:<international>)?<4><0>"),
    ("cc-by-nc-4.0", "<creative><commons><attribution>(?:<non><commercial>|<noncommercial>)(?:<international>)?<4><0>"),
    ("cc-by-nc-nd-4.0", "<creative><commons><attribution><noncommercial><noderiv(?:ative)?s>(?:<international>)?<4><0>"),
    ("cc-by-nc-sa-4.0", "<creative><commons><attribution><noncommercial><sharealike>(?:<international>)?<4><0>"),
    ("cc-by-nd-4.0", "<creative><commons><attribution><noderiv(?:ative)?s>(?:<international>)?<4><0>"),
    ("cc-by-sa-3.0", "<creative><commons><attribution>(?:<share><alike>|<sharealike>)(?:<unported>)?<3><0>"),
    ("cc-by-sa-4.0", "<creative><commons><attribution>(?:<share><alike>|<sharealike>)(?:<international>)?<4><0>"),
    ("cc0-1.0", "<creative><commons>(?:<cc0>|<zero>)(?:<1><0>)?(?:<universal>)?"),
    ("cddl-1.0", f"<common><development><and><distribution><license>(?:{_V}<v?1>{_0})?"),
    ("cecill-2.1", f"<cecill>(?:<free><software>)?<license>(?:<agreement>)?{_V}<v?2><1>"),
    ("clartistic", "<clarified><artistic><license>"),
    ("cpal-1.0", f"<common><public><attribution><license>(?:{_V}<v?1>{_0})?"),
    ("cpl-1.0", f"<common><public><license>(?:{_V}<v?1>{_0})?"),
    ("ecl-2.0", f"<educational><community><license>(?:{_V}<v?2>{_0})?"),
    ("efl-2.0", f"<eiffel><forum><license>(?:{_V}<v?2>)?"),
    ("elastic-2.0", f"<elastic><license>(?:{_V}<v?2>{_0})?"),
    ("epl-1.0", f"<eclipse><public><license>{_V}<v?1>{_0}"),
    ("epl-2.0", f"<eclipse><public><license>{_V}<v?2>{_0}"),
    ("eupl-1.1", f"<european><union><public><license>{_V}<v?1><1>"),
    ("eupl-1.2", f"<european><union><public><licence>(?:{_V}<v?1><2>)?"),
    ("fair", "<fair><license>"),
    ("ftl", "<freetype><(?:project|license)>(?:<license>)?"),
    ("gfdl-1.2", f"<free><documentation><license>{_V}<v?1><2>"),
    ("gfdl-1.3", f"<free><documentation><license>{_V}<v?1><3>"),
    ("gpl-1.0", f"<gnu><general><public><licen[cs]e>{_GNU_V.format(1)}"),
    ("gpl-2.0", f"<gnu><general><public><licen[cs]e>(?:<as><published><by><the><free><software><foundation>(?:<either>)?)?{_GNU_V.format(2)}"),
    ("gpl-3.0", f"<gnu><general><public><licen[cs]e>(?:<as><published><by><the><free><software><foundation>(?:<either>)?)?{_GNU_V.format(3)}"),
    ("hpnd", "<historical><permission><notice><and><disclaimer>"),
    ("icu", "<icu><license>"),
    ("ijg", "<independent><jpeg><group>"),
    ("ipl-1.0", f"<ibm><public><license>(?:{_V}<v?1>{_0})?"),
    ("isc", "<isc><license>"),
    ("lgpl-2.0", f"<gnu><library><general><public><license>(?:{_GNU_V.format(2)})?"),
    ("lgpl-2.1", f"<gnu><lesser><general><public><license>{_V}<v?2><1>"),
    ("lgpl-3.0", f"<gnu><lesser><general><public><license>{_GNU_V.format(3)}"),
    ("libpng", "<libpng><license>"),
    ("lppl-1.3c", f"<latex><project><public><license>(?:{_V}<v?1><3c?>)?"),
    ("lpl-1.02", f"<lucent><public><license>(?:{_V}<v?1><02>)?"),
    ("miros", "<miros><licence>"),
    ("mit", "<mit><licen[cs]e>"),
    ("mit-0", "<mit><no><attribution>(?:<license>)?"),
    ("mpl-1.0", f"<mozilla><public><license>{_V}<v?1><0>"),
    ("mpl-1.1", f"<mozilla><public><license>{_V}<v?1><1>"),
    ("mpl-2.0", f"<mozilla><public><license>{_V}<v?2>{_0}"),
    ("ms-pl", "<microsoft><public><license>"),
    ("ms-rl", "<microsoft><reciprocal><license>"),
    ("mulanpsl-2.0", f"<mulan><permissive><software><license>(?:{_V}<v?2>)?"),
    ("ncsa", "<university><of><illinois><ncsa><open><source><license>"),
    ("npl-1.1", f"<netscape><public><license>(?:{_V}<v?1><1>)?"),
    ("odbl-1.0", f"<open>(?:<data><commons><open>)?<database><license>(?:{_V}<v?1>{_0})?"),
    ("odc-by-1.0", "<open><data><commons><attribution><license>(?:<v?1><0>)?"),
    ("ofl-1.1", f"<sil><open><font><license>(?:{_V}<v?1><1>)?"),
    ("openssl", "<openssl><license>"),
    ("osl-3.0", f"<open><software><license>(?:{_V}<v?3>{_0})?"),
    ("php-3.01", f"<php><license>(?:{_V}<v?3><01>)?"),
    ("postgresql", "<postgresql><licen[cs]e>"),
    ("psf-2.0", f"<python><software><foundation><license>(?:{_V}<v?2>)?"),
    ("qpl-1.0", f"<q><public><license>(?:{_V}<v?1>{_0})?"),
    ("rpl-1.5", f"<reciprocal><public><license>(?:{_V}<v?1><5>)?"),
    ("ruby", "<ruby><license>"),
    ("sissl", "<sun><industry><standards><source><license>"),
    ("sleepycat", "<sleepycat><license>"),
    ("spl-1.0", f"<sun><public><license>(?:{_V}<v?1>{_0})?"),
    ("sspl-1.0", f"<server><side><public><license>(?:{_V}<v?1>{_0})?"),
    ("unicode-3.0", "<unicode><license>(?:<v?3>)?"),
    ("unlicense", "<unlicense>"),
    ("upl-1.0", f"<universal><permissive><license>(?:{_V}<v?1>{_0})?"),
    ("vim", "<vim><license>"),
    ("w3c", "<w3c><software>(?:<notice><and>)?<license>"),
    ("wtfpl", "<fuck><you><want><to><public><license>"),
    ("x11", "<x11><license>"),
    ("xnet", "<xnet><license>"),
    ("zlib", "<zlib>(?:<libpng>)?<license>"),
    ("zpl-2.1", f"<zope><public><license>(?:{_V}<v?2><1>)?"),
)

#: Licence and a phrase of its text or usual notice.
TEXTS = (
    ("agpl", "<gnu><affero><general><public><license>"),
    ("apache-2.0", "<apache><license><version><2><0><january><2004>"),
    ("apache-2.0", "<unless><required><by><applicable><law><or><agreed><to><in><writing>"),
    ("artistic", "<standard><version><refers><to>(?:<such><a>|<the>)<package>"),
    ("bsd", "<redistribution><and><use><in><source><and><binary><forms><with><or><without><modification>"),
    ("bsd", "<redistributions><of><source><code><must><retain><the><above><copyright><notice>"),
    ("bsd-3-clause", "<neither><the><names?><of>(?:<the>)?(?:<[a-z0-9]+>){1,6}<may><be><used><to><endorse>"),
    ("bsd-4-clause", "<advertising><materials><mentioning><features><or><use><of><this><software>"),
    ("bsl-1.0", "<boost><software><license><version><1><0><august><17th><2003>"),
    ("cc-by", "<cc><by><(?:1|2|3|4)><[05]>"),
    ("cc-by-nc", "<cc><by><nc><(?:1|2|3|4)><[05]>"),
    ("cc-by-nc-nd", "<cc><by><nc><nd><(?:1|2|3|4)><[05]>"),
    ("cc-by-nc-sa", "<cc><by><nc><sa><(?:1|2|3|4)><[05]>"),
    ("cc-by-nd", "<cc><by><nd><(?:1|2|3|4)><[05]>"),
    ("cc-by-sa", "<cc><by><sa><(?:1|2|3|4)><[05]>"),
    ("cc0-1.0", "<cc0>(?:<1><0>)?(?:<universal>)?"),
    ("gpl", "<free><software><you><can><redistribute><it><and><or><modify><it><under><the><terms><of><the><gnu><general><public><license>"),
    ("gpl-2.0", "<gplv2>(?:<or><later>)?"),
    ("gpl-3.0", "<gplv3>(?:<or><later>)?"),
    ("isc", "<permission><to><use><copy><modify><and><or><distribute><this><software><for><any><purpose>"),
    ("lgpl", "<free><software><you><can><redistribute><it><and><or><modify><it><under><the><terms><of><the><gnu><lesser><general><public><license>"),
    ("mit", "<permission><is><hereby><granted><free><of><charge><to><any><person><obtaining><a><copy>"),
    ("mpl-2.0", "<source><code><form><is><subject><to><the><terms><of><the><mozilla><public><license>"),
    ("ofl-1.1", "<sil><open><font><license><version><1><1><26><february><2007>"),
    ("public-domain", "<dedicated><to><the><public><domain>"),
    ("public-domain", "<released><into><the><public><domain>"),
    ("proprietary", "<rights><reserved>"),
    ("proprietary", "<proprietary><and><confidential>"),
    ("unlicense", "<free><and><unencumbered><software><released><into><the><public><domain>"),
    ("zlib", "<altered><source><versions><must><be><plainly><marked><as><such>"),
)

#: Names without a version, or of a family.
MENTIONS = (
    ("affero-gpl", "<affero><gpl>"),
    ("apache", "<apache><licen[cs]e>"),
    ("bsd", "<bsd>(?:<style>)?<licen[cs]e>"),
    ("cc", "<creative><commons>(?:<licen[cs]e>)?"),
    ("epl", "<eclipse><public><license>"),
    ("gpl", "<general><public><licen[cs]e>"),
    ("gpl", "<gnu><gpl>"),
    ("lgpl", "<lesser><general><public><license>"),
    ("lgpl", "<gnu><lgpl>"),
    ("mpl", "<mozilla><public><license>"),
    ("proprietary", "<proprietary><licen[cs]e>"),
    ("commercial", "<commercial><licen[cs]e>"),
)

#: The contract's phrases; their places are counted before any suppression.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Classes in order of priority, each with what one detection of it is worth.
WORTH = {"tag": 1.0, "text": 0.95, "link": 0.9, "notice": 0.85, "name": 0.75, "short": 0.6, "mention": 0.5}
CLASSES = tuple(WORTH)
#: A rule reads at most this many words.
SPAN = 24


@dataclass(frozen=True)
class Rule:
    number: int
    kind: int
    label: str
    first: str
    need: str
    pattern: str


def _spelled(label: str) -> str:
    return "".join(f"<{w}>" for w in re.split(r"[-.]", label))


def _first(pattern: str) -> str:
    return re.match(r"<([a-z0-9]+)>", pattern).group(1)


def rules() -> tuple[Rule, ...]:
    """All rules in order: by class, then as written."""
    made: list[tuple[str, str, str, str]] = []
    for label, name in NAMES:
        own, short = _first(name), _spelled(label)
        key = _first(short)
        version = "(?:<only>|<or><later>|<plus>)?"
        made.append(("tag", label, key, f"<spdx><license><identifier>{short}{version}"))
        made.append(("link", label, key, f"<opensource><org>(?:<licenses?>){short}(?:<(?:php|html|txt)>)?"))
        made.append(("link", label, key, f"<spdx><org><licenses>{short}(?:<html>)?"))
        for verb in ("licensed", "released", "distributed", "available"):
            made.append(("notice", label, own, f"<{verb}><under>{_TERMS}{name}"))
        made.append(("name", label, own, name))
        if short.count("<") > 1:
            made.append(("short", label, key, short + version))
    made += [("text", label, _first(p), p) for label, p in TEXTS] + [("mention", label, _first(p), p) for label, p in MENTIONS]
    ordered = sorted(made, key=lambda r: CLASSES.index(r[0]))
    return tuple(
        Rule(n, CLASSES.index(kind), label, _first(p), f" {need} ", p.replace("<", " ").replace(">", " "))
        for n, (kind, label, need, p) in enumerate(ordered)
    )
