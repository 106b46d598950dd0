"""License scans by ordered signature rules.

A rule has a label, a priority, a keyword and a pattern, all written by hand below. Only rules whose
keyword (a part of all that the rule matches) the text contains are run; most texts hold none of the
few `needles`, which are derived from the rules so that each match holds one, and are passed by. Of overlapping detections, one whose interval lies within that of a detection of higher rank
(priority, then length, then label) is suppressed.

Base rules: places where the words of a phrase stand one after the other; their labels always stay.

Defined results: a null text is an empty one; without a detection labels are empty and score is 0;
score is the highest confidence (priority / 100) among the detections that remain, at least 0.5
where a base phrase stands. Rows are treated one by one, so repeated rows and null ids don't matter;
an input column named like an output is replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._native import fixed, let, matches, scan, without

PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
_IN, _OUT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: label | name pattern | identifier pattern | address pattern. Patterns meet lower-cased text; "_" is any run of white space, "_?" one or none.
#: Priorities: identifier 90, address 80, name 70.
LICENSES = r"""
0bsd | (?:zero[- ]clause_bsd|bsd_zero[- ]clause)(?:_license)? | \b0bsd\b | (?:opensource\.org/licenses?|spdx\.org/licenses)/0bsd
afl-3.0 | academic_free_license(?:,?_(?:version|v\.?)_?3(?:\.0)?)? | \bafl-?3\.0\b | opensource\.org/licenses?/afl-3\.0
agpl-3.0 | (?:gnu_)?affero_general_public_licen[cs]e(?:,?_(?:version|v\.?)_?3(?:\.0)?)? | \bagpl(?:-?v?3(?:\.0)?)(?:-only|-or-later|\+)? | gnu\.org/licenses/agpl(?:-3\.0)?
apache-1.1 | apache_(?:software_)?licen[cs]e,?_(?:version|v\.?)_?1\.1 | \bapache-1\.1\b | apache\.org/licenses/license-1\.1
apache-2.0 | apache_(?:software_)?licen[cs]e,?_(?:\()?(?:version|v\.?)?_?2(?:\.0)? | \bapache-2\.0\b | apache\.org/licenses/license-2\.0
apsl-2.0 | apple_public_source_licen[cs]e(?:_(?:version_)?2(?:\.0)?)? | \bapsl-2\.0\b | opensource\.apple\.com/apsl
artistic-1.0 | artistic_licen[cs]e,?_(?:version_)?1(?:\.0)? | \bartistic-1\.0\b | opensource\.org/licenses?/artistic-1\.0
artistic-2.0 | artistic_licen[cs]e,?_(?:version_)?2(?:\.0)? | \bartistic-2\.0\b | (?:opensource\.org/licenses?/artistic-2\.0|perlfoundation\.org/artistic)
beerware | beer-?_?ware_licen[cs]e | \bbeerware\b | people\.freebsd\.org/~phk
blueoak-1.0.0 | blue_oak_model_licen[cs]e | \bblueoak-1\.0\.0\b | blueoakcouncil\.org/license
bsl-1.0 | boost_software_licen[cs]e | \bbsl-1\.0\b | boost\.org/license_1_0
bsd-2-clause | (?:simplified_bsd|bsd_2[- ]clause|2[- ]clause_bsd|freebsd)_licen[cs]e | \bbsd-2-clause\b | opensource\.org/licenses?/bsd-2-clause
bsd-3-clause | (?:(?:new|modified|revised)_bsd|bsd_3[- ]clause|3[- ]clause_bsd)_licen[cs]e | \bbsd-3-clause\b | opensource\.org/licenses?/bsd-3-clause
bsd-4-clause | (?:original_bsd|bsd_4[- ]clause|4[- ]clause_bsd)_licen[cs]e | \bbsd-4-clause\b | spdx\.org/licenses/bsd-4-clause
busl-1.1 | business_source_licen[cs]e(?:_(?:version_)?1\.1)? | \bbusl-1\.1\b | mariadb\.com/bsl11
cc-by-1.0 | (?:creative_commons_)?attribution_1\.0(?:_(?:generic|unported|international))? | \bcc[- ]by[- ]1\.0\b | creativecommons\.org/licenses/by/1\.0
cc-by-2.0 | (?:creative_commons_)?attribution_2\.0(?:_(?:generic|unported))? | \bcc[- ]by[- ]2\.0\b | creativecommons\.org/licenses/by/2\.0
cc-by-2.5 | (?:creative_commons_)?attribution_2\.5(?:_(?:generic|unported))? | \bcc[- ]by[- ]2\.5\b | creativecommons\.org/licenses/by/2\.5
cc-by-3.0 | (?:creative_commons_)?attribution_3\.0(?:_(?:unported))? | \bcc[- ]by[- ]3\.0\b | creativecommons\.org/licenses/by/3\.0
cc-by-4.0 | (?:creative_commons_)?attribution_4\.0(?:_international)? | \bcc[- ]by[- ]4\.0\b | creativecommons\.org/licenses/by/4\.0
cc-by-nc-2.0 | attribution-noncommercial_2\.0 | \bcc[- ]by-nc[- ]2\.0\b | creativecommons\.org/licenses/by-nc/2\.0
cc-by-nc-3.0 | attribution-noncommercial_3\.0 | \bcc[- ]by-nc[- ]3\.0\b | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-4.0 | attribution-noncommercial_4\.0 | \bcc[- ]by-nc[- ]4\.0\b | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-nd-3.0 | attribution-noncommercial-noderiv(?:ative)?s_3\.0 | \bcc[- ]by-nc-nd[- ]3\.0\b | creativecommons\.org/licenses/by-nc-nd/3\.0
cc-by-nc-nd-4.0 | attribution-noncommercial-noderiv(?:ative)?s_4\.0 | \bcc[- ]by-nc-nd[- ]4\.0\b | creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-sa-3.0 | attribution-noncommercial-sharealike_3\.0 | \bcc[- ]by-nc-sa[- ]3\.0\b | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-sa-4.0 | attribution-noncommercial-sharealike_4\.0 | \bcc[- ]by-nc-sa[- ]4\.0\b | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nd-3.0 | attribution-noderiv(?:ative)?s_3\.0 | \bcc[- ]by-nd[- ]3\.0\b | creativecommons\.org/licenses/by-nd/3\.0
cc-by-nd-4.0 | attribution-noderiv(?:ative)?s_4\.0 | \bcc[- ]by-nd[- ]4\.0\b | creativecommons\.org/licenses/by-nd/4\.0
cc-by-sa-2.0 | attribution-share_?alike_2\.0 | \bcc[- ]by-sa[- ]2\.0\b | creativecommons\.org/licenses/by-sa/2\.0
cc-by-sa-3.0 | attribution-share_?alike_3\.0 | \bcc[- ]by-sa[- ]3\.0\b | creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-4.0 | attribution-share_?alike_4\.0 | \bcc[- ]by-sa[- ]4\.0\b | creativecommons\.org/licenses/by-sa/4\.0
cc0-1.0 | (?:creative_commons_zero|cc0_1\.0_universal|cc0_public_domain_dedication) | \bcc0(?:-1\.0)?\b | creativecommons\.org/publicdomain/zero
cddl-1.0 | common_development_and_distribution_licen[cs]e(?:_\(?(?:cddl)?\)?_?(?:version_)?1\.0)? | \bcddl-1\.0\b | opensource\.org/licenses?/cddl-1\.0
cddl-1.1 | common_development_and_distribution_licen[cs]e_\(?(?:cddl)?\)?_?(?:version_)?1\.1 | \bcddl-1\.1\b | glassfish\.java\.net/public/cddl
cecill-2.1 | cecill(?:_free_software)?_licen[cs]e(?:_agreement)? | \bcecill-2\.[01]\b | cecill\.info/licences
cpl-1.0 | common_public_licen[cs]e(?:_(?:version_)?1\.0)? | \bcpl-1\.0\b | opensource\.org/licenses?/cpl1\.0
ecl-2.0 | educational_community_licen[cs]e(?:,?_version_2\.0)? | \becl-2\.0\b | opensource\.org/licenses?/ecl-2\.0
efl-2.0 | eiffel_forum_licen[cs]e(?:,?_version_2)? | \befl-2\.0\b | eiffel-nice\.org/license
elastic-2.0 | elastic_licen[cs]e(?:_2\.0)? | \belastic-2\.0\b | elastic\.co/licensing/elastic-license
epl-1.0 | eclipse_public_licen[cs]e(?:_-)?,?_(?:version|v)?_?1\.0 | \bepl-1\.0\b | eclipse\.org/legal/epl-v10
epl-2.0 | eclipse_public_licen[cs]e(?:_-)?,?_(?:version|v)?_?2\.0 | \bepl-2\.0\b | eclipse\.org/legal/epl-(?:v20|2\.0)
eupl-1.2 | european_union_public_licen[cs]e(?:,?_(?:version|v\.?)_?1\.2)? | \beupl-1\.[12]\b | joinup\.ec\.europa\.eu/.{0,40}eupl
gfdl-1.3 | gnu_free_documentation_licen[cs]e(?:,?_version_1\.[123])? | \bgfdl-1\.[123]\b | gnu\.org/licenses/fdl
gpl-1.0 | (?:gnu_)?general_public_licen[cs]e,?_(?:version|v\.?)_?1(?:\.0)? | \bgpl-?v?1(?:\.0)?(?:-only|-or-later|\+)?\b | gnu\.org/licenses/old-licenses/gpl-1\.0
gpl-2.0 | (?:gnu_)?general_public_licen[cs]e,?_(?:version|v\.?)_?2(?:\.0)? | \bgpl-?v?2(?:\.0)?(?:-only|-or-later|\+)?\b | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | (?:gnu_)?general_public_licen[cs]e,?_(?:version|v\.?)_?3(?:\.0)? | \bgpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?\b | gnu\.org/licenses/gpl-3\.0
hpnd | historical_permission_notice_and_disclaimer | \bhpnd\b | opensource\.org/licenses?/hpnd
ijg | independent_jpeg_group(?:'s)?_licen[cs]e | \bijg\b_licen[cs]e | ijg\.org/files/readme
imagemagick | imagemagick_licen[cs]e | licen[cs]e:_imagemagick\b | imagemagick\.org/script/license
ipl-1.0 | ibm_public_licen[cs]e(?:_version_1\.0)? | \bipl-1\.0\b | opensource\.org/licenses?/ipl-1\.0
isc | \bisc_licen[cs]e | spdx-license-identifier:_isc\b | opensource\.org/licenses?/isc
json | \bjson_licen[cs]e | spdx-license-identifier:_json\b | json\.org/license
lgpl-2.0 | (?:gnu_)?library_general_public_licen[cs]e(?:,?_(?:version|v\.?)_?2(?:\.0)?)? | \blgpl-?v?2\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0
lgpl-2.1 | (?:gnu_)?lesser_general_public_licen[cs]e,?_(?:version|v\.?)_?2\.1 | \blgpl-?v?2\.1(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | (?:gnu_)?lesser_general_public_licen[cs]e,?_(?:version|v\.?)_?3(?:\.0)? | \blgpl-?v?3(?:\.0)?(?:-only|-or-later|\+)? | gnu\.org/licenses/lgpl-3\.0
libpng | (?:png_reference_library|libpng)_licen[cs]e | \blibpng-2\.0\b | libpng\.org/pub/png/src/libpng-license
lppl-1.3c | latex_project_public_licen[cs]e | \blppl-1\.3[ac]?\b | latex-project\.org/lppl
mit | (?:the_)?mit_licen[cs]e | spdx-license-identifier:_mit\b | opensource\.org/licenses?/mit
mit-0 | mit_no[- ]attribution(?:_licen[cs]e)? | \bmit-0\b | (?:opensource\.org/licenses?/mit-0|github\.com/aws/mit-0)
mpl-1.1 | mozilla_public_licen[cs]e,?_(?:version|v\.?)?_?1\.1 | \bmpl-?_?1\.1\b | mozilla\.org/mpl/(?:mpl-)?1\.1
mpl-2.0 | mozilla_public_licen[cs]e,?_(?:version|v\.?)?_?2\.0 | \bmpl-?_?2\.0\b | mozilla\.org/(?:en-us/)?mpl/2\.0
ms-pl | microsoft_public_licen[cs]e | \bms-pl\b | opensource\.org/licenses?/ms-pl
ms-rl | microsoft_reciprocal_licen[cs]e | \bms-rl\b | opensource\.org/licenses?/ms-rl
mulanpsl-2.0 | mulan_permissive_software_licen[cs]e | \bmulanpsl-2\.0\b | license\.coscl\.org\.cn/mulanpsl2
ncsa | (?:university_of_illinois/)?ncsa_open_source_licen[cs]e | spdx-license-identifier:_ncsa\b | opensource\.org/licenses?/ncsa
odbl-1.0 | open_database_licen[cs]e | \bodbl(?:-1\.0)?\b | opendatacommons\.org/licenses/odbl
odc-by-1.0 | open_data_commons_attribution_licen[cs]e | \bodc-by(?:-1\.0)?\b | opendatacommons\.org/licenses/by
ofl-1.1 | sil_open_font_licen[cs]e | \bofl-1\.1\b | scripts\.sil\.org/ofl
openssl | openssl_licen[cs]e | licen[cs]e:_openssl\b | openssl\.org/source/license
osl-3.0 | open_software_licen[cs]e(?:,?_(?:version|v\.?)_?3(?:\.0)?)? | \bosl-3\.0\b | opensource\.org/licenses?/osl-3\.0
pddl-1.0 | (?:open_data_commons_)?public_domain_dedication_and_licen[cs]e | \bpddl(?:-1\.0)?\b | opendatacommons\.org/licenses/pddl
php-3.01 | \bphp_licen[cs]e(?:,?_version_3\.01)? | \bphp-3\.01\b | php\.net/license
postgresql | postgresql_licen[cs]e | spdx-license-identifier:_postgresql\b | postgresql\.org/about/licence
python-2.0 | (?:python_software_foundation|psf)_licen[cs]e | \b(?:python|psf)-2\.0\b | (?:python\.org/psf/license|docs\.python\.org/[^ ]{0,12}license)
ruby | \bruby_licen[cs]e | licen[cs]e:_ruby\b | ruby-lang\.org/[^ ]{0,24}license
sspl-1.0 | server_side_public_licen[cs]e | \bsspl(?:-1\.0)?\b | mongodb\.com/licensing/server-side-public-license
unlicense | (?:the_)?unlicense\b | spdx-license-identifier:_unlicense\b | unlicense\.org
upl-1.0 | universal_permissive_licen[cs]e | \bupl-1\.0\b | oss\.oracle\.com/licenses/upl
vim | \bvim_licen[cs]e | licen[cs]e:_vim\b | vimdoc\.sourceforge\.net/htmldoc/uganda
w3c | \bw3c_software(?:_notice_and|_and_document_notice_and)?_licen[cs]e | spdx-license-identifier:_w3c\b | w3\.org/consortium/legal/[^ ]{0,40}software
wtfpl | do_what_the_f\S{1,4}_you_want_to_public_licen[cs]e | \bwtfpl\b | wtfpl\.net
x11 | \b(?:x11|x_consortium)_licen[cs]e | spdx-license-identifier:_x11\b | x\.org/releases/[^ ]{0,40}license
zlib | \bzlib(?:/libpng)?_licen[cs]e | spdx-license-identifier:_zlib\b | zlib\.net/zlib_license
zpl-2.1 | zope_public_licen[cs]e(?:_\(zpl\))?(?:_version_2\.1)? | \bzpl-2\.1\b | zope\.org/resources/zpl
"""

#: label | priority | keyword | pattern: wording of licenses and general notices.
WORDINGS = r"""
mit | 60 | permission is hereby granted | permission_is_hereby_granted,_free_of_charge,_to_any_person_obtaining_a_copy
mit | 55 | above copyright notice | the_above_copyright_notice_and_this_permission_notice_shall_be_included
isc | 60 | permission to use, copy | permission_to_use,_copy,_modify,_and(?:/or)?_distribute_this_software_for_any_purpose
bsd | 50 | redistribution and use | redistribution_and_use_in_source_and_binary_forms
bsd-3-clause | 55 | endorse or promote | neither_the_name_of_.{1,80}may_be_used_to_endorse_or_promote
bsd-4-clause | 58 | advertising materials | all_advertising_materials_mentioning_features_or_use_of_this_software
apache-2.0 | 60 | licensed under the apache | licensed_under_the_apache_licen[cs]e,_version_2\.0_\(the
gpl | 55 | free software foundation | under_the_terms_of_the_gnu_general_public_licen[cs]e_as_published_by_the_free_software_foundation
lgpl | 57 | lesser general public | under_the_terms_of_the_gnu_lesser_general_public_licen[cs]e
agpl | 57 | affero general public | under_the_terms_of_the_gnu_affero_general_public_licen[cs]e
gpl | 40 | general public licen | gnu_general_public_licen[cs]e
lgpl | 45 | lesser general public | gnu_lesser_general_public_licen[cs]e
apache | 40 | apache licen | apache_licen[cs]e
mit | 40 | mit licen | mit_licen[cs]e
mpl-2.0 | 60 | source code form is subject | this_source_code_form_is_subject_to_the_terms_of_the_mozilla_public_licen[cs]e
unlicense | 60 | released into the public domain | this_is_free_and_unencumbered_software_released_into_the_public_domain
public-domain | 45 | public domain | (?:dedicated_to|released_into|placed_in)_the_public_domain
zlib | 60 | as-is | this_software_is_provided_'as-is',_without_any_express_or_implied_warranty
boost | 60 | boost software | distributed_under_the_boost_software_licen[cs]e
cc-by-nc | 45 | noncommercial | creative_commons_attribution-noncommercial
cc-by-nc | 42 | cc by-nc | \bcc_by-nc\b
cc-by-sa | 45 | sharealike | creative_commons_attribution-sharealike
cc-by-sa | 42 | cc by-sa | \bcc_by-sa\b
cc-by-nd | 42 | cc by-nd | \bcc_by-nd\b
cc-by | 35 | creative commons attribution | creative_commons_attribution\b
creative-commons | 30 | creative commons | creative_commons
all-rights-reserved | 50 | all rights reserved | all_rights_reserved\.?
all-rights-reserved | 50 | alle rechte vorbehalten | alle_rechte_vorbehalten\.?
all-rights-reserved | 50 | tous droits | tous_droits_r[ée]serv[ée]s\.?
all-rights-reserved | 50 | todos los derechos | todos_los_derechos_reservados\.?
copyright | 30 | copyright | copyright_(?:\(c\)|©)?_?(?:19|20)[0-9]{2}
copyright | 30 | © | ©_?(?:19|20)[0-9]{2}
proprietary | 45 | proprietary | (?:proprietary_and_confidential|confidential_and_proprietary)
warranty-disclaimer | 35 | without warranty | without_warranty_of_any_kind
warranty-disclaimer | 35 | without any warranty | without_any_warranty
warranty-disclaimer | 35 | as is | provided_["']?as_is["']?_without
license-reference | 20 | licensed under | licensed_under_(?:the_)?[a-z0-9.-]{2,30}
license-reference | 20 | released under | released_under_(?:the_)?[a-z0-9.-]{2,30}_licen[cs]e
license-reference | 20 | spdx-license-identifier | spdx-license-identifier:_[a-z0-9.+-]{2,40}
"""
OUT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def _keyword(pattern: str) -> str:
    """A substring that each match of the pattern has: the longest literal run outside groups, optional parts and classes."""
    best, run, depth, i = "", "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        literal = ""
        if c == "\\":
            literal = pattern[i + 1] if not pattern[i + 1].isalnum() else ""
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "{":
            i = pattern.index("}", i)
        elif c not in "_|.^$?*+":
            literal = c
        follows = pattern[i + 1] if i + 1 < len(pattern) else ""
        if literal and not depth and follows not in ("?", "*", "{"):
            run += literal
        else:
            best, run = max(best, run, key=len), ""
        i += 1
    return max(best, run, key=len)


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern)"""
    out = []
    for line in LICENSES.strip().splitlines():
        label, *patterns = (x.strip() for x in line.split(" | "))
        out += [(label, priority, _keyword(p), p) for priority, p in zip((70, 90, 80), patterns, strict=True)]
    for line in WORDINGS.strip().splitlines():
        label, priority, keyword, p = (x.strip() for x in line.split(" | "))
        out.append((label, int(priority), max([*keyword.split(" "), _keyword(p)], key=len), p))
    return [(label, priority, keyword, p.replace("_", r"(?:\s+)")) for label, priority, keyword, p in out]


def needles() -> list[str]:
    """Short strings of which each match of each rule holds one: those that are parts of the most keywords first."""
    keys: set[str] = set()
    for _, _, keyword, p in rules():
        # without a keyword: one of each alternative
        keys |= {keyword} if keyword else {_keyword(x) for x in p.replace(r"(?:\s+)", "_").removeprefix("(?:").replace("(?:_license)?", "").removesuffix(")").split("|")}
    parts: dict[str, set[str]] = {}
    for k in keys:
        found = {k[i : i + 7] for i in range(len(k) - 6)} | {k[i : i + 3] for i in range(len(k) - 2) if not k[i : i + 3].isalpha()}
        for x in found or {k}:
            parts.setdefault(x, set()).add(k)
    out = []
    while keys:
        out.append(min(parts, key=lambda x: (-len(parts[x] & keys), x)))
        keys = keys - parts[out[-1]]
    return out


def unsuppressed(found: Column) -> Column:
    """Of (start, end, label, priority) those that lie within no other of higher rank; of equal ones, one.

    In order of start, then from long to short, then by rank, what may contain a detection comes before it; a running
    maximum of the ends, for each priority over those at least as high, tells whether one does."""
    levels = sorted({r[1] for r in rules()})
    order = F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("back"), (-d["priority"]).alias("low"), d["label"].alias("label")))
    at = F.array(*map(F.lit, levels))

    def step(reached: Column, x: Column) -> Column:
        return F.transform(reached, lambda e, i: F.when(F.get(at, i) <= -x["low"], F.greatest(e, -x["back"])).otherwise(e))

    def free(reached: Column, x: Column) -> Column:
        return F.get(reached, F.array_position(at, -x["low"]).cast("int") - 1) < -x["back"]

    zero = F.array_repeat(F.lit(-1).cast("long"), len(levels))

    def kept(a: Column) -> Column:
        left = let(scan(a, zero, step, free, "boolean"), lambda ok: F.filter(a, lambda x, i: F.get(ok, i)))
        return F.transform(left, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["label"].alias("label"), (-x["low"]).alias("priority")))

    return let(F.array_sort(order), kept)


def detections(low: Column) -> Column:
    """Array of (start, end, label, priority), what is suppressed left out; low: the text with A-Z as a-z, null to pass it by."""
    table = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(k).alias("keyword"), F.lit(p).alias("pattern")) for label, priority, k, p in rules()))
    near = F.filter(table, lambda r: F.contains(low, r["keyword"]))
    found = F.flatten(F.transform(near, lambda r: F.transform(matches(low, r["pattern"]), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), r["label"].alias("label"), r["priority"].alias("priority")))))
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string,priority:int>>")
    return F.when(low.isNotNull(), let(found, lambda a: F.when(F.size(a) > 1, unsuppressed(a)).otherwise(a))).otherwise(none)


def licenses(docs: DataFrame) -> DataFrame:
    """docs with OUT and `detections`."""
    t, low, base, found = "__license_text", "__license_low", "__license_base", "detections"
    text = F.col(t)

    def places(label: str) -> Column:
        p = rf"(?i)(?<!{_IN})" + rf"{_OUT}+".join(PHRASES[label].split()) + rf"(?!{_IN})"
        return F.transform(matches(text, p), lambda m: F.struct(m["start"].alias("start"), F.lit(label).alias("label")))

    gate = text.rlike("(?i)" + "|".join(rf"{w[0]}{_OUT}+{w[1]}" for w in (x.split() for x in PHRASES.values())))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    taken = {*OUT, found}
    d = docs.select(*without(docs, *taken), F.coalesce(docs["text"], F.lit("")).alias(t))
    # lower() also changes other letters, so it only decides which texts are looked at
    d = d.withColumn("__license_any", F.lower(text))
    near = reduce(or_, (F.contains(F.col("__license_any"), F.lit(x)) for x in needles()))
    capitals = "".join(map(chr, range(65, 91)))
    d = d.withColumns({low: fixed(F.when(near, F.translate(text, capitals, capitals.lower()))), base: fixed(F.when(gate, F.concat(*map(places, PHRASES))).otherwise(none))})
    d = d.withColumn(found, fixed(detections(F.col(low))))

    def words_before(at: Column) -> Column:
        return F.regexp_count(F.substring(text, F.lit(1), at.cast("int")), F.lit(f"{_IN}+")).cast("long")

    starts = F.transform(base, lambda p: p["start"])
    base_labels = F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform(base, lambda p: p["label"]), F.transform(found, lambda m: m["label"]))))
    score = F.coalesce(F.array_max(F.concat(F.transform(found, lambda m: m["priority"] / 100.0), F.transform(base, lambda p: F.lit(0.5)))), F.lit(0.0))
    out = {
        "n_words": F.regexp_count(text, F.lit(f"{_IN}+")).cast("long"),
        "n_base": F.size(base).cast("long"),
        "first_word": F.when(F.size(base) > 0, words_before(F.array_min(starts))),
        "last_word": F.when(F.size(base) > 0, words_before(F.array_max(starts))),
        "base_labels": F.array_join(base_labels, ","),
        "labels": F.array_join(labels, ","),
        "score": score.cast("double"),
    }
    keep = [c for c in docs.columns if c.lower() not in taken]
    return d.select(*(F.col(f"`{c}`") for c in keep), *(v.alias(k) for k, v in out.items()), found)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", *OUT)
