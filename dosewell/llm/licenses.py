"""License scans: ordered signature rules behind a keyword prefilter.

Every license has a title pattern, which the forms below turn into rules of different priority, and many
have signatures of their own from the words of their grants and notices. A
rule's pattern runs only on texts that hold its keyword. Of the detections in a text, one that lies
inside a detection of higher priority, or inside a longer one of the same priority, is dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewell.llm.common import LOWER, flat, groups

#: Phrases that are always counted, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label | keyword | title pattern, on lower-cased text. `~` stands for what may divide words. A keyword is a
#: word or pattern that every match of its title contains.
#: `{v}` stands for a version, the label's last part.
TITLES = """
mit | mit | mit(?:~x11)?
mit-0 | mit | mit(?:~|-)no~attribution
x11 | x11 | x11
apache-1.0 | apache | apache(?:~software)?(?:~license)?,?{v}
apache-1.1 | apache | apache(?:~software)?(?:~license)?,?{v}
apache-2.0 | apache | apache(?:~software)?(?:~license)?,?{v}
bsd-2-clause | bsd | (?:(?:two|2)(?:~|-)clause~bsd|bsd(?:~|-)(?:two|2)(?:~|-)clause|(?:simplified|freebsd)~bsd)
bsd-3-clause | bsd | (?:(?:three|3)(?:~|-)clause~bsd|bsd(?:~|-)(?:three|3)(?:~|-)clause|(?:new|revised|modified)~bsd)
bsd-4-clause | bsd | (?:(?:four|4)(?:~|-)clause~bsd|bsd(?:~|-)(?:four|4)(?:~|-)clause|original~bsd)
0bsd | bsd | (?:zero(?:~|-)clause~bsd|0bsd)
gpl-1.0 | gener | (?:gnu~)?general~public(?:~license)?,?{v}
gpl-2.0 | gener | (?:gnu~)?general~public(?:~license)?,?{v}
gpl-3.0 | gener | (?:gnu~)?general~public(?:~license)?,?{v}
lgpl-2.0 | gener | (?:gnu~)?(?:library|lesser)~general~public(?:~license)?,?{v}
lgpl-2.1 | lesser | (?:gnu~)?lesser~general~public(?:~license)?,?{v}
lgpl-3.0 | lesser | (?:gnu~)?lesser~general~public(?:~license)?,?{v}
agpl-3.0 | affero | (?:gnu~)?affero~general~public(?:~license)?,?{v}
gfdl-1.2 | free~documentation | (?:gnu~)?free~documentation(?:~license)?,?{v}
gfdl-1.3 | free~documentation | (?:gnu~)?free~documentation(?:~license)?,?{v}
mpl-1.0 | mozilla | mozilla~public(?:~license)?,?{v}
mpl-1.1 | mozilla | mozilla~public(?:~license)?,?{v}
mpl-2.0 | mozilla | mozilla~public(?:~license)?,?{v}
epl-1.0 | eclipse | eclipse~public(?:~license)?,?{v}
epl-2.0 | eclipse | eclipse~public(?:~license)?,?{v}
cddl-1.0 | common~development | common~development~and~distribution(?:~license)?,?{v}
cddl-1.1 | common~development | common~development~and~distribution(?:~license)?,?{v}
eupl-1.1 | european~union | european~union~public(?:~license|~licence)?,?{v}
eupl-1.2 | european~union | european~union~public(?:~license|~licence)?,?{v}
artistic-1.0 | artistic | artistic(?:~license)?,?{v}
artistic-2.0 | artistic | artistic(?:~license)?,?{v}
bsl-1.0 | boost | boost~software(?:~license)?,?{v}
osl-3.0 | open~software | open~software(?:~license)?,?{v}
afl-3.0 | academic | academic~free(?:~license)?,?{v}
cpl-1.0 | common~public | common~public(?:~license)?,?{v}
ipl-1.0 | ibm | ibm~public(?:~license)?,?{v}
psf-2.0 | python | python~software~foundation(?:~license)?,?{v}
ms-pl | microsoft | microsoft~public
ms-rl | microsoft | microsoft~reciprocal
isc | isc | isc
zlib | zlib | zlib(?:/libpng)?
libpng | libpng | libpng
unlicense | unlicense | (?:the~)?unlicense
wtfpl | wtfpl | wtfpl
ncsa | ncsa | (?:university~of~illinois/)?ncsa~open~source
ofl-1.1 | open~font | (?:sil~)?open~font(?:~license)?,?{v}
ecl-2.0 | educational | educational~community(?:~license)?,?{v}
upl-1.0 | universal~permissive | universal~permissive(?:~license)?,?{v}
zpl-2.1 | zope | zope~public(?:~license)?,?{v}
php-3.01 | php | php(?:~license)?,?{v}
postgresql | postgresql | postgresql
openssl | openssl | openssl
ruby | ruby | ruby
vim | vim | vim
cc0-1.0 | cc0 | cc0(?:~universal)?,?{v}
cc-by-3.0 | cc(?:~|-)by | cc(?:~|-)by{v}
cc-by-4.0 | cc(?:~|-)by | cc(?:~|-)by{v}
cc-by-sa-3.0 | cc(?:~|-)by-sa | cc(?:~|-)by-sa{v}
cc-by-sa-4.0 | cc(?:~|-)by-sa | cc(?:~|-)by-sa{v}
cc-by-nc-3.0 | cc(?:~|-)by-nc | cc(?:~|-)by-nc{v}
cc-by-nc-4.0 | cc(?:~|-)by-nc | cc(?:~|-)by-nc{v}
cc-by-nd-4.0 | cc(?:~|-)by-nd | cc(?:~|-)by-nd{v}
cc-by-nc-sa-4.0 | cc(?:~|-)by-nc-sa | cc(?:~|-)by-nc-sa{v}
cc-by-nc-nd-4.0 | cc(?:~|-)by-nc-nd | cc(?:~|-)by-nc-nd{v}
odbl-1.0 | open~database | open~database(?:~license)?,?{v}
odc-by-1.0 | open~data~commons | open~data~commons~attribution(?:~license)?,?{v}
openrail | open~?rail | (?:creativeml~|bigscience~)?open~?rail(?:-m)?
proprietary | all~rights~reserved | all~rights~reserved
agpl-1.0 | affero | (?:gnu~)?affero~general~public(?:~license)?,?{v}
gfdl-1.1 | free~documentation | (?:gnu~)?free~documentation(?:~license)?,?{v}
eupl-1.0 | european~union | european~union~public(?:~license|~licence)?,?{v}
osl-2.1 | open~software | open~software(?:~license)?,?{v}
afl-2.1 | academic | academic~free(?:~license)?,?{v}
apsl-2.0 | apple | apple~public~source(?:~license)?,?{v}
rpl-1.5 | reciprocal | reciprocal~public(?:~license)?,?{v}
cecill-2.1 | cecill | cecill(?:~license)?,?{v}
qpl-1.0 | q~public | q~public(?:~license)?,?{v}
lppl-1.3c | latex | latex~project~public(?:~license)?,?{v}
spl-1.0 | sun~public | sun~public(?:~license)?,?{v}
npl-1.1 | netscape | netscape~public(?:~license)?,?{v}
mulanpsl-2.0 | mulan | mulan~permissive~software(?:~license)?,?{v}
blueoak-1.0.0 | blue~oak | blue~oak~model(?:~license)?,?{v}
busl-1.1 | business~source | business~source(?:~license)?,?{v}
sspl-1.0 | server~side | server~side~public(?:~license)?,?{v}
elastic-2.0 | elastic | elastic(?:~license)?,?{v}
polyform-noncommercial-1.0.0 | polyform | polyform~noncommercial(?:~license)?,?{v}
hippocratic-2.1 | hippocratic | hippocratic(?:~license)?,?{v}
parity-7.0 | parity | parity~public(?:~license)?,?{v}
ogl-3.0 | open~government | open~government(?:~license|~licence)?,?{v}
w3c | w3c | w3c~software
ijg | jpeg | independent~jpeg~group
sleepycat | sleepycat | sleepycat
hpnd | historical | historical~permission~notice~and~disclaimer
beerware | beer | beer-?ware
json | json | json
curl | curl | curl
bzip2 | bzip2 | bzip2
icu | icu | icu
ftl | freetype | freetype(?:~project)?
cc-by-2.0 | cc(?:~|-)by | cc(?:~|-)by{v}
cc-by-2.5 | cc(?:~|-)by | cc(?:~|-)by{v}
cc-by-sa-2.0 | cc(?:~|-)by-sa | cc(?:~|-)by-sa{v}
cc-by-nd-3.0 | cc(?:~|-)by-nd | cc(?:~|-)by-nd{v}
cc-by-nc-sa-3.0 | cc(?:~|-)by-nc-sa | cc(?:~|-)by-nc-sa{v}
cc-by-nc-nd-3.0 | cc(?:~|-)by-nc-nd | cc(?:~|-)by-nc-nd{v}
"""

#: label | keyword | signature of a grant or notice, on lower-cased text. `~` stands for blanks, quotes and
#: the signs that begin lines of comments; the keyword is a word that every match contains.
BODIES = r"""
mit | hereby | permission~is~hereby~granted~free~of~charge~to~any~person~obtaining~a~copy(?:~of~this~software(?:~and~associated~documentation~files)?)?(?![0-9a-z])(?!~of~the~unicode)
mit-0 | hereby | permission~is~hereby~granted~free~of~charge~to~any~person~obtaining~a~copy~of~this~software[^.]{0,500}furnished~to~do~so\.~the~software~is~provided
ncsa | hereby | permission~is~hereby~granted~free~of~charge~to~any~person~obtaining~a~copy~of~this~software[^.]{0,400}to~deal~with~the~software
bsl-1.0 | hereby | permission~is~hereby~granted~free~of~charge~to~any~person~or~organization~obtaining~a~copy
unicode-dfs-2016 | unicode | permission~is~hereby~granted~free~of~charge~to~any~person~obtaining~a~copy~of~the~unicode~data~files
upl-1.0 | hereby | subject~to~the~condition~set~forth~below~permission~is~hereby~granted
x11 | contained | except~as~contained~in~this~notice~the~names?(?:\(s\))?~of
isc | permission | permission~to~use~copy~modify~(?:and~or|and)~distribute~this~software~for~any~purpose~with~or~without~fee~is~hereby~granted~provided~that
0bsd | permission | permission~to~use~copy~modify~(?:and~or|and)~distribute~this~software~for~any~purpose~with~or~without~fee~is~hereby~granted\.
hpnd | permission | permission~to~use~copy~modify~(?:and~or|and)~distribute~this~software~and~its~documentation~for~any~purpose~(?:and~)?without~fee
postgresql | permission | permission~to~use~copy~modify~and~distribute~this~software~and~its~documentation~for~any~purpose~without~fee~and~without~a~written~agreement
bsd | redistribution | redistribution~and~use~in~source~and~binary~forms~with~or~without~modification
bsd-2-clause | redistribution | redistribution~and~use~in~source~and~binary~forms~with~or~without~modification~are~permitted~provided~that~the~following~conditions~are~met
bsd-3-clause | redistribution | redistribution~and~use~in~source~and~binary~forms~with~or~without~modification[\s\S]{0,1500}?(?:neither~the~names?~of|may~not~be~used)[\s\S]{0,200}?(?:endorse|promote)
bsd-4-clause | redistribution | redistribution~and~use~in~source~and~binary~forms~with~or~without~modification[\s\S]{0,1200}?all~advertising~materials~mentioning~features[\s\S]{0,900}?(?:endorse|promote)
sleepycat | redistributions | redistributions~in~any~form~must~be~accompanied~by~information~on~how~to~obtain~complete~source~code
openssl | openssl | this~product~includes~software~developed~by~the~openssl~project
php-3.01 | php | this~product~includes~php~software
zlib | misrepresented | the~origin~of~this~software~must~not~be~misrepresented
apache-2.0 | apache | licensed~under~the~apache~license~version~2\.0~\(the~license
gpl-2.0 | redistribute | you~can~redistribute~it~and~or~modify~it~under~the~terms~of~(?:version~2~of~)?the~gnu~general~public~license(?:[^.]{0,80}version~2(?!\d|\.\d)|~as~published)
gpl-3.0 | redistribute | you~can~redistribute~it~and~or~modify~it~under~the~terms~of~the~gnu~general~public~license~as~published~by~the~free~software~foundation[^.]{0,20}version~3(?!\d)
lgpl-2.0 | redistribute | you~can~redistribute~it~and~or~modify~it~under~the~terms~of~the~gnu~library~general~public~license
lgpl-2.1 | redistribute | you~can~redistribute~it~and~or~modify~it~under~the~terms~of~the~gnu~lesser~general~public~license~as~published~by~the~free~software~foundation[^.]{0,20}version~2\.1
lgpl-3.0 | redistribute | you~can~redistribute~it~and~or~modify~it~under~the~terms~of~the~gnu~lesser~general~public~license~as~published~by~the~free~software~foundation[^.]{0,20}version~3(?!\d)
agpl-3.0 | affero | under~the~terms~of~the~gnu~affero~general~public~license~as~published
gfdl-1.2 | documentation | permission~is~granted~to~copy~distribute~and~or~modify~this~document~under~the~terms~of~the~gnu~free~documentation~license~version~1\.2
gfdl-1.3 | documentation | permission~is~granted~to~copy~distribute~and~or~modify~this~document~under~the~terms~of~the~gnu~free~documentation~license~version~1\.3
mpl-1.1 | mozilla | the~contents~of~this~file~are~subject~to~the~mozilla~public~license~version~1\.1
mpl-2.0 | mozilla | this~source~code~form~is~subject~to~the~terms~of~the~mozilla~public~license~v\.?~?2\.0
epl-1.0 | eclipse | made~available~under~the~terms~of~the~eclipse~public~license~v(?:ersion)?~?1\.0
epl-2.0 | eclipse | made~available~under~the~terms~of~the~eclipse~public~license~v?(?:ersion~)?~?2\.0
cddl-1.0 | development | the~contents~of~this~file~are~subject~to~the~terms~of~the~common~development~and~distribution~license
eupl-1.2 | eupl | licensed~under~the~eupl~(?:version~|v~?)?1\.2
unlicense | unencumbered | this~is~free~and~unencumbered~software~released~into~the~public~domain
wtfpl | fuck | do~what~the~fuck~you~want~to
beerware | beer | you~can~buy~me~a~beer
cc0-1.0 | waive | (?:has~waived|waives|waive)~all~copyright~and~related~or~neighboring~rights
cc-by-3.0 | creative | creative~commons~attribution~3\.0
cc-by-4.0 | creative | creative~commons~attribution~4\.0
cc-by-sa-3.0 | creative | creative~commons~attribution~share~?alike~3\.0
cc-by-sa-4.0 | creative | creative~commons~attribution~share~?alike~4\.0
cc-by-nc-3.0 | creative | creative~commons~attribution~non~?commercial~3\.0
cc-by-nc-4.0 | creative | creative~commons~attribution~non~?commercial~4\.0
cc-by-nd-4.0 | creative | creative~commons~attribution~no~?deriv(?:ative)?s~4\.0
cc-by-nc-sa-3.0 | creative | creative~commons~attribution~non~?commercial~share~?alike~3\.0
cc-by-nc-sa-4.0 | creative | creative~commons~attribution~non~?commercial~share~?alike~4\.0
cc-by-nc-nd-4.0 | creative | creative~commons~attribution~non~?commercial~no~?deriv(?:ative)?s~4\.0
ofl-1.1 | font | this~font~software~is~licensed~under~the~sil~open~font~license
vim | charityware | vim~is~charityware
json | evil | the~software~shall~be~used~for~good~not~evil
artistic-1.0 | package | the~intent~of~this~document~is~to~state~the~conditions~under~which~a~package~may~be~copied
ms-pl | governs | this~license~governs~use~of~the~accompanying~software
odbl-1.0 | database | made~available~under~the~open~database~license
cecill-2.1 | cecill | governed~by~the~cecill~license
ruby | bsdl | under~either~the~terms~of~the~2~clause~bsdl
ijg | jpeg | based~in~part~on~the~work~of~the~independent~jpeg~group
gpl-1.0 | gpl | {b}(?:gnu~)?gpl(?:~|-)?(?:version~|v(?:er)?\.?~?)?1(?:\.0)?(?:-only|-or-later|\+)?{e}(?!\.\d)
gpl-2.0 | gpl | {b}(?:gnu~)?gpl(?:~|-)?(?:version~|v(?:er)?\.?~?)?2(?:\.0)?(?:-only|-or-later|\+)?{e}(?!\.\d)
gpl-3.0 | gpl | {b}(?:gnu~)?gpl(?:~|-)?(?:version~|v(?:er)?\.?~?)?3(?:\.0)?(?:-only|-or-later|\+)?{e}(?!\.\d)
lgpl-2.0 | lgpl | {b}(?:gnu~)?lgpl(?:~|-)?(?:version~|v(?:er)?\.?~?)?2(?:\.0)?(?:-only|-or-later|\+)?{e}(?!\.\d)
lgpl-2.1 | lgpl | {b}(?:gnu~)?lgpl(?:~|-)?(?:version~|v(?:er)?\.?~?)?2\.1(?:-only|-or-later|\+)?{e}
lgpl-3.0 | lgpl | {b}(?:gnu~)?lgpl(?:~|-)?(?:version~|v(?:er)?\.?~?)?3(?:\.0)?(?:-only|-or-later|\+)?{e}(?!\.\d)
agpl-3.0 | agpl | {b}(?:gnu~)?agpl(?:~|-)?(?:version~|v(?:er)?\.?~?)?3(?:\.0)?(?:-only|-or-later|\+)?{e}(?!\.\d)
unlicense | unlicense | {b}the~unlicense{e}
cc0-1.0 | cc0 | {b}cc0(?:-1\.0)?{e}
ftl | freetype | portions~of~this~software~are~copyright[^.]{0,80}the~freetype~project
info-zip | info | of~the~info~zip~(?:license|copyright~and~license)
commons-clause | commons | commons~clause~(?:license~)?condition
openrail | restrictions | use~based~restrictions~(?:as~)?referenced~in~paragraph
llama-community | llama | llama~(?:2|3|3\.\d|4)~community~licen[sc]e(?:~agreement)?
public-domain | domain | (?:placed|released|dedicated)~(?:into|in|to)~the~public~domain
proprietary | confidential | (?:proprietary~and~confidential|confidential~and~proprietary)
proprietary | unauthori | unauthori[sz]ed~(?:copying|reproduction|distribution)[^.]{0,80}prohibited
"""
#: What begins and ends a word in patterns.
BEGIN, END = r"(?<![0-9a-z_\x80-\xff])", r"(?![0-9a-z_\x80-\xff])"
#: Priority and score of those signatures.
BODY_PRIORITY, BODY_SCORE = 3, 0.97

#: priority, score, keyword ({k} is the title's), and the form around a title `{t}` or label `{l}`;
#: `{f}` is a title that has a version and spells out the word license, `{b}` and `{e}` begin and end a word.
FORMS = (
    (4, 1.0, "spdx", r"spdx-license-identifier:[ \t]*(?:[\w.+()-]+[ \t]+){0,40}?\(*({l}(?:-only|-or-later|\+)?)(?![\w.-])"),
    (3, 0.95, "{k}", r"(?:licensed|released|distributed|available|published)~under(?:~the)?(?:~terms~of(?:~the)?)?~{t}(?:~licen[sc]e)?{e}"),
    (2, 0.9, "{k}", r"{b}{t}~(?:public~)?licen[sc]e{e}"),
    (2, 0.9, "{k}", r"{b}{f}{e}(?!-)"),
    (1, 0.7, "licen", r"{b}licen[sc]e\s*[:=]\s*[\"']?{l}(?![\w.-])"),
)

_WORD = b"0-9a-z\\x80-\\xff"


def base_patterns() -> list[tuple[re.Pattern, str]]:
    out = []
    for phrase, label in BASE:
        words = (b"[^" + _WORD + b"]+").join(re.escape(w.encode()) for w in phrase.split())
        out.append((re.compile(b"(?<![" + _WORD + b"])" + words + b"(?![" + _WORD + b"])"), label))
    return out


def signature_rules() -> list[tuple[int, float, bytes, re.Pattern, str]]:
    """(priority, score, keyword, pattern, label) of every title in every form and of every body, in order of priority."""
    out = []
    for line in TITLES.strip().splitlines():
        label, key, title = (x.strip() for x in line.split(" | "))
        version = re.escape(label.rpartition("-")[2]).removesuffix(r"\.0") + (r"(?:\.0)?" if label.endswith(".0") else "")
        full = re.sub(r"\(\?:~license(?:\|~licence)?\)\?", "~licen[sc]e", title) if "{v}" in title and "~license" in title else ""
        number = rf"(?:~|-)(?:version~|v(?:er)?\.?~?)?{version}(?!\d|\.\d)"
        title, full = title.replace("{v}", number), full.replace("{v}", number)
        for priority, score, keyword, form in FORMS:
            if "{f}" in form and not full:
                continue
            form = form.replace("{b}", BEGIN).replace("{e}", END)
            pattern = form.replace("{t}", f"(?:{title})").replace("{f}", f"(?:{full})").replace("{l}", re.escape(label)).replace("~", r"(?:[\s,]+)")
            out.append((priority, score, keyword.replace("{k}", key).encode(), re.compile(pattern.encode("latin-1")), label))
    for line in BODIES.strip().splitlines():
        label, key, body = (x.strip() for x in line.split(" | "))
        out.append((BODY_PRIORITY, BODY_SCORE, key.encode(), re.compile(body.replace("{b}", BEGIN).replace("{e}", END).replace("~", r"""(?:[\s,*#/;>"'`-]+)""").encode("latin-1")), label))
    return sorted(out, key=lambda r: -r[0])


def gate(keyword: bytes) -> re.Pattern | None:
    """The pattern of a keyword that may have several forms; None where it is a plain word."""
    return None if keyword.isalnum() else re.compile(keyword.replace(b"~", rb"(?:[\s,]+)"))


def held_keywords(text: bytes, at: np.ndarray, gates: dict[bytes, re.Pattern | None]) -> dict[int, set[bytes]]:
    """The keywords in each of the texts that make up `text`, text k from at[k] to at[k + 1]; texts without any are left out."""
    held: dict[int, set[bytes]] = {}
    for key, pattern in gates.items():
        if pattern is None:
            find = lambda p, key=key: (q := text.find(key, p), q + len(key))
        else:
            find = lambda p, pattern=pattern: m.span() if (m := pattern.search(text, p)) else (-1, -1)
        p, end = find(0)
        while p >= 0:  # one look a text is enough
            d = int(np.searchsorted(at, p, side="right")) - 1
            if end <= at[d + 1]:
                held.setdefault(d, set()).add(key)
                p, end = find(int(at[d + 1]))
            else:  # it runs into the next text
                p, end = find(p + 1)
    return held


def kept_detections(found: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """Of (priority, start, end, score, label), those that no better one contains."""
    out: list[tuple[int, int, int, float, str]] = []
    starts: list[int] = []
    ends: list[int] = []  # the largest end of the kept ones up to each start
    for priority in sorted({f[0] for f in found}, reverse=True):
        most, new = -1, []
        for f in sorted((f for f in found if f[0] == priority), key=lambda f: (f[1], -f[2], f[4])):
            k = bisect_right(starts, f[1])
            if (k and ends[k - 1] >= f[2]) or most >= f[2]:
                continue
            most = f[2]
            new.append(f)
        out += new
        spans = sorted((f[1], f[2]) for f in out)
        starts, ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    return out


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses that every whole text names: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Texts are lower-cased (A-Z only); words are runs of digits, letters and non-ASCII characters.
    n_base counts all places of the base phrases, first_word and last_word are the least and the
    largest word number at which one starts (null without one). `labels` has the base labels and
    those of the kept detections, sorted and joined by commas; `score` is the best kept detection's,
    0 without any. A null or empty text has 0 words and empty labels; repeated rows give repeated
    results; an empty table gives no rows; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rules = base_patterns(), signature_rules()
        gates = {key: gate(key) for key in sorted({r[2] for r in rules})}
        for b in batches:
            x, off = flat(b.column(1))
            for i, j in groups(off):
                at = off[i : j + 1] - off[i]
                text = x[off[i] : off[j]].tobytes().translate(LOWER)
                word = _WORD_BYTE[np.frombuffer(text, np.uint8)]
                begin = word.copy()
                begin[1:] &= ~word[:-1]
                heads = at[:-1][at[:-1] < at[1:]]
                begin[heads] = word[heads]
                upto = np.concatenate(([0], np.cumsum(begin, dtype=np.int64)))
                rows = j - i
                n_base, first, last = np.zeros(rows, np.int64), [None] * rows, [None] * rows
                labels, base_labels, score = [""] * rows, [""] * rows, np.zeros(rows)
                held = held_keywords(text, at, gates)
                for d, keys in held.items():
                    lo, hi = int(at[d]), int(at[d + 1])
                    own = text[lo:hi]
                    names = set()
                    places = []
                    for pattern, label in base if b"license" in own else ():
                        for m in pattern.finditer(own):
                            names.add(label)
                            places.append(int(upto[lo + m.start()] - upto[lo]))
                    if places:
                        n_base[d], first[d], last[d] = len(places), min(places), max(places)
                    base_labels[d] = ",".join(sorted(names))
                    found = [(pr, *m.span(m.lastindex or 0), s, label) for pr, s, key, pattern, label in rules if key in keys for m in pattern.finditer(own)]  # a group is the part that counts
                    kept = kept_detections(found)
                    labels[d] = ",".join(sorted(names | {k[4] for k in kept}))
                    score[d] = max([k[3] for k in kept] + [0.8] * bool(names) + [0.0])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, rows), pa.array(upto[at[1:]] - upto[at[:-1]]), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score)],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
