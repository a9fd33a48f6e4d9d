"""Which carriers a running text refers to: known names found once each, and what is left of its objects.

Names are searched longest first at word boundaries, and a character belongs
to one name only (``claimed``).  What a responsibility or an action is about is
an object; an object that known names do not exhaust is judged by what is
left: an attribute or an act, an unlisted document, a run of known names
without separators (``unique_cover``), or something that can't be read.

Grammars 1 to 5 differ in boundaries, aliases and in what leftovers they
understand.  Everything is an expression over the row: ``known`` is an array
of struct<term, name>, longest term first; texts are normalised.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.functions.duties import occurrences, once

# Attributes, and how objects of a sentence are found and cleaned.
QUALITY = "准确性|一致性|真实性|完整性|合规性|及时性|规范性|有效性|安全性"
ACTION_QUALITY = f"(?:签订|编制|填写|登记|录入|报送|审批|审核|核对|执行)(?:{QUALITY})"
QUALITY_TAIL = f"(?:的)?(?:{QUALITY})(?:[、，,]|(?:及|和|与))?(?:(?:{QUALITY})(?:[、，,]|(?:及|和|与))?)*$"
DESCRIBED_TAIL = f"的[^!?！？。；;]{{1,40}}(?:{QUALITY})(?:(?:[、，,]|及|和|与)(?:{QUALITY}))*$"
QUOTED = r"《([^<>《》]{1,120})》"
RESPONSIBILITY_OBJECT = r"对([^!?！？。；;]{1,240}?)(?:(?:负有?|承担)(?:主体|审核|审批)?责任|负责)(?:[!?！？。；;]|$)"
CLAUSE_OBJECT = r"对((?:(?![，,](?:并|且|而)?对)[^!?！？。；;]){1,240}?)(?:(?:负有?|承担)(?:主体|审核|审批)?责任|负责)(?:[，,!?！？。；;]|$)"
ACTION_OBJECT = r"(?:^|[，,。；;])(?:负责|核对|确保|保证)([^!?！？。；;]{1,160})"
GENERIC_OBJECTS = ("本岗位工作", "本职工作", "岗位工作", "工作", "相关工作", "职责范围内工作", "涉及财务管理的部分", "财务管理的部分", "相关事项", "有关事项", "某事项", "移交")
BEHAVIOUR = r"^(?:(?:确保|保证|保持)?账(?:卡物?|实|账|表)(?:相符|一致)|(?:涉及)?[一-鿿]{1,30}管理的部分|(?:本|相关|有关)?[一-鿿]{0,16}(?:工作|事项|业务))$"
DOCUMENT_ENDINGS = r"(?:申请单|审批单|计划单|清单|明细表|台账|卡片|记录|报告|协议|合同|凭证|档案|方案|表单|文件|资料|单|表)$"
ACTION_STARTS = r"^(?:按时|及时|按照|按规定|开展|收集|审核|编制|提交|发起|发布|上传|确保|保证|负责|核对)"
FRAGMENT_STARTS = r"[,，对]|^(?:会同|组织|复核|进行|自动|办理|督促)"

# Boundaries of names, acts and documents.
BEFORE = r"(?:^|[对、，,；;。:：()（）\[\]【】《》\n]|及|和|与)$"
AFTER = rf"^(?:$|[、，,；;。:：()（）\[\]【】《》\n的]|及|和|与|{QUALITY}|{ACTION_QUALITY}|涉及财务管理的部分|财务管理的部分)"
BEFORE_3 = r"(?:^|[对、,，;；。:：()《》]|(?:审核|复核|核对|提交|报送|编制|填写|检查|对照|确认|查阅|开具|签订|保存|取得|提供)的?)$"
AFTER_3 = r"^(?:$|[的中内上、,，;；。:：()《》]|准确|一致|完整|真实|金额|信息|条款|填报|编制|审批|审核|物品|品名|数量|规格|型号|时间|人员|地点|事由|用途|税率|摘要|价格|内容|编号)"
BEFORE_4 = r"(?:^|[对、,;及和与]|以及|确认|校验|核对|提交|检查|复核)$"
AFTER_4 = r"^(?:$|条款|税率|约定|通过|信息|内容|签订|履行|中|上|内|的|以及|及|和|与)"
DOCUMENT_CUE = r"报告|协议|合同|凭证|档案|方案|文件|资料|台账|清单|记录|单据|证明|通知书|申请书|发票|收据|订单|账簿|账册|(?:单|表)(?=$|[的中内上、,，;；及和与]|准确|一致|完整|真实)"
CONTROL_ACTION = r"选择|初审|复核|确认|核对|校验|填报|报送|检查|监督|追究|落实|控制|执行|办理|组织|开展|整改|报销|支付|发放|归集|分配|列支|管理|保管|签订|填写|编制|提交"
DOCUMENT_END = r"(?:申请单|审批单|通知书|申请书|说明书|证明材料|制度|办法|规定|发票|收据|合同|协议|报告|凭证|清单|台账|记录|明细表|汇总表|单据|附件|单|表)$"
NON_DOCUMENT = (
    r"^(?:追责|程序|标准|用工|使用范围|预算管控|超发|滥发|(?:超发|滥发|兑现)?职工薪酬|企业负责人薪酬兑现|服务内容|付款方式|关键信息|信息|内容|金额|税率|条款|"
    r"数量|规格|型号|品名|价格|时间|地点|事由|用途|真实性|合理性|准确性|一致性|完整性|及时性)$"
)
ALTERNATIVE_END = r"(?:合同|协议|发票|收据|报告|清单|凭证|单|表)$"
INVOICES = ("增值税发票", "增值税专用发票", "增值税普通发票")
POLICY = r"^(.{3,80}?(?:制度|办法|条例))(?:的)?执行$"
ACT_AS_NAME = r"^(?:使用|按照|依据|根据|所管辖|每月)|(?:起草|生成|进行|开展|按照|依据)"
CONTRACT_ACCOUNT = r"^(?:确保)?使用((?:[一-鿿]{1,16})?合同)约定(?:的)?账户(?:进行)?支付$"
COMPLETE_ACT = r"^(?:组织)?出险报案(?:与|及|和)后续配合$"
ORDER_ATTRIBUTES = r"^人员、时间、订单的合理性(?:与|和|及)唯一性$"

SEPARATORS = "、,，;；"
KNOWN = "array<struct<term:string,name:string>>"
_NAMES = "array<string>"
_SPAN = "array<struct<start:int,end:int,name:string>>"

Bound = Callable[[Column, Column], Column]


def _plain(left: Column, right: Column) -> Column:
    return left.rlike(BEFORE) & right.rlike(AFTER)


def _acts(left: Column, right: Column) -> Column:
    return _plain(left, right) | (left.rlike(BEFORE_3) & right.rlike(AFTER_3))


def _data(left: Column, right: Column) -> Column:
    return left.rlike(BEFORE_4) & right.rlike(AFTER_4)


def longest_first(known: Column) -> Column:
    """struct<term, name> in the order in which names are searched: by length, longest first, then by the term."""
    keyed = F.transform(F.array_distinct(F.filter(known, lambda k: k["term"] != "")), lambda k: F.struct((-F.length(k["term"])).alias("size"), k["term"].alias("term"), k["name"].alias("name")))
    return F.transform(F.array_sort(keyed), lambda k: F.struct(k["term"].alias("term"), k["name"].alias("name")))


def claimed(text: Column, known: Column, *bounds: Bound) -> Column:
    """The names found: array<struct<start, end, name>>.

    Every occurrence of a term within bounds, term by term as ``known`` lists
    them, claims its characters unless one of them is taken.  Further bounds
    go through the terms again.
    """

    def of(bound: Bound) -> Column:
        def places(k: Column) -> Column:
            found = occurrences(text, F.concat(F.lit("\\Q"), k["term"], F.lit("\\E")))
            inside = F.filter(found, lambda m: bound(F.substr(text, F.lit(1), m["start"]), F.substr(text, m["end"] + 1)))
            return F.transform(inside, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), k["name"].alias("name")))

        return F.flatten(F.transform(known, places))

    def take(taken: Column, one: Column) -> Column:
        return F.when(F.exists(taken, lambda t: (one["start"] < t["end"]) & (one["end"] > t["start"])), taken).otherwise(F.concat(taken, F.array(one)))

    return F.aggregate(F.concat(*(of(b) for b in bounds)), F.array().cast(_SPAN), take)


def left_over(text: Column, spans: Column, filler: str = "") -> Column:
    """The text without its claimed characters."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("rest"))
    step = lambda s, m: F.struct(m["end"].alias("at"), F.concat(s["rest"], F.substr(text, s["at"] + 1, m["start"] - s["at"]), F.lit(filler)).alias("rest"))
    done = F.aggregate(F.array_sort(spans), start, step)
    return F.concat(done["rest"], F.substr(text, done["at"] + 1))


def unique_cover(text: Column, known: Column, shortest: int = 3, longest_text: int = 240) -> Column:
    """The names of the one way to read the text as two or more known terms of ``shortest`` characters or more, separators between them allowed; null without exactly one.

    Ways are counted from left to right, place by place, and never beyond
    two, so the work grows with places and occurrences, not with the ways.
    """
    whole = F.regexp_replace(text, f"^[{SEPARATORS}]+|[{SEPARATORS}]+$", "")
    terms = F.filter(known, lambda k: (F.length(k["term"]) >= shortest) & (k["term"] != whole))
    size = F.length(text)
    edge = lambda start, end, names: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), names.alias("names"))
    places = F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: i < size)
    steps = F.flatten(
        F.transform(
            places,
            lambda i: F.when(
                F.substr(text, i + 1, F.lit(1)).isin(*SEPARATORS), F.array(edge(i, i + 1, F.array().cast(_NAMES)))
            ).otherwise(F.transform(F.filter(terms, lambda k: F.substr(text, i + 1, F.length(k["term"])) == k["term"]), lambda k: edge(i, i + F.length(k["term"]), F.array(k["name"])))),
        )
    )
    state = lambda ways, names: F.struct(ways.cast("int").alias("ways"), names.cast(_NAMES).alias("names"))
    begin = F.transform(F.sequence(F.lit(0), size), lambda i: state(F.when(i == 0, 1).otherwise(0), F.array()))

    def walk(ways: Column, e: Column) -> Column:
        here = F.get(ways, e["start"])
        then = lambda w: state(F.least(w["ways"] + here["ways"], F.lit(2)), F.when(w["ways"] > 0, w["names"]).otherwise(F.concat(here["names"], e["names"])))
        return F.when(here["ways"] == 0, ways).otherwise(F.transform(ways, lambda w, i: F.when(i == e["end"], then(w)).otherwise(w)))

    last = F.get(F.aggregate(steps, begin, walk), size)
    return F.when((size <= longest_text) & (last["ways"] == 1) & (F.size(last["names"]) >= 2), last["names"])


def _stripped(value: Column) -> Column:
    """Without the attributes at the end."""
    text = F.regexp_replace(F.regexp_replace(value, "^[、，,]+|[、，,]+$", ""), DESCRIBED_TAIL, "")
    act = f"(?:{ACTION_QUALITY})$"
    cut = lambda t: F.regexp_replace(F.when(t.rlike(act), F.regexp_replace(t, act, "")).otherwise(F.regexp_replace(t, QUALITY_TAIL, "")), "[的、，,]+$", "")
    return F.aggregate(F.sequence(F.lit(1), F.floor(F.length(text) / 3).cast("int") + 1), text, lambda t, _: cut(t))


def _behaves(value: Column) -> Column:
    compact = F.regexp_replace(value, "[、，,]", "")
    return compact.isin(*GENERIC_OBJECTS) | compact.rlike(BEHAVIOUR)


def _names(spans: Column) -> Column:
    return F.transform(spans, lambda m: m["name"])


def local_aliases(allowed: Column, version: int) -> Column:
    """Short names that the carriers of a measure give themselves: array<struct<term, name>>, only those that mean one carrier."""
    pair = lambda term, name: F.struct(term.alias("term"), name.alias("name"))
    none = F.array().cast(KNOWN)

    def own(label: Column) -> Column:
        bracket = F.regexp_extract(label, r"^([^()]+)\([^()]+\)$", 1)
        either = F.filter(F.split(label, "或"), lambda x: x.rlike(ALTERNATIVE_END))
        found = [F.when(bracket != "", F.array(pair(bracket, label))).otherwise(none), F.when(label.contains("或"), F.transform(either, lambda x: pair(x, label))).otherwise(none)]
        if version >= 4:
            listed = F.split(label, "及|和|与")
            choice = F.regexp_replace(F.regexp_replace(label, "^(?:相关的|相应的)", ""), "等$", "")
            choices = F.split(choice, "或")
            stage = [F.regexp_extract(label, "^(.*?)初设/施设(报告)$", k) for k in (1, 2)]
            found += [
                F.when(label == "发票", F.array(*(pair(F.lit(n), label) for n in INVOICES))).otherwise(none),
                F.when(label == "合同文本", F.array(pair(F.lit("合同"), label))).when(label == "合同", F.array(pair(F.lit("合同文本"), label))).otherwise(none),
                F.when(label.endswith("报销审批单") & (label != "报销审批单"), F.array(pair(F.lit("报销审批单"), label))).otherwise(none),
                F.when((F.size(listed) > 1) & F.forall(listed, lambda x: x.rlike(DOCUMENT_END)), F.transform(listed, lambda x: pair(x, label))).otherwise(none),
                F.when((F.size(choices) > 1) & F.forall(choices, lambda x: x.rlike(DOCUMENT_END)), F.concat(F.transform(choices, lambda x: pair(x, label)), F.array(pair(choice, label)))).otherwise(none),
                F.when(stage[1] != "", F.array(*(pair(F.concat(stage[0], F.lit(s), stage[1]), label) for s in ("初设", "施设")))).otherwise(none),
            ]
        return F.concat(*found)

    every = F.array_distinct(F.filter(F.flatten(F.transform(allowed, own)), lambda x: (x["term"] != "") & (x["term"] != x["name"]) & ~F.array_contains(allowed, x["term"])))
    one = F.filter(every, lambda x: F.size(F.filter(every, lambda y: y["term"] == x["term"])) == 1)
    if version >= 4:
        # An invoice of some kind is the one carrier that names invoices.
        invoices = F.filter(allowed, lambda x: F.array_contains(F.split(x, "或"), "发票"))
        kinds = F.filter(F.array(*(F.lit(n) for n in INVOICES)), lambda n: ~F.array_contains(allowed, n) & ~F.exists(one, lambda x: x["term"] == n))
        one = F.concat(one, F.when(F.size(invoices) == 1, F.transform(kinds, lambda n: pair(n, F.get(invoices, F.lit(0))))).otherwise(none))
    return one


def with_references(rows: DataFrame, text: str, allowed: str, grammar: int, aliases: dict[str, str] | None = None, vocabulary: str | None = None, name: str = "_refs") -> DataFrame:
    """``rows`` with struct ``name``: references, unavailable (fragments that can't be read) and status.

    ``allowed``: array of the carriers that the row may name; ``vocabulary``:
    array of names that are recognised but not allowed; both columns.  Status is
    matched, unresolved (a reference is not allowed), unavailable or not_applicable.
    """
    known, source, read, parts = (f"_{name}_{k}" for k in ("known", "source", "read", "parts"))
    pair = lambda term, target: F.struct(term.alias("term"), target.alias("name"))
    fixed = F.array(*(pair(F.lit(k), F.lit(v)) for k, v in (aliases or {}).items())).cast(KNOWN)
    own = F.concat(fixed, local_aliases(F.col(allowed), grammar)) if grammar >= 3 else fixed
    words = F.coalesce(F.col(vocabulary), F.array().cast(_NAMES)) if vocabulary else F.array().cast(_NAMES)
    if grammar >= 4:
        words = F.filter(words, lambda w: w.rlike(DOCUMENT_END))
    normal = F.coalesce(F.col(text), F.lit(""))
    if grammar >= 4:
        normal = F.replace(F.replace(normal, F.lit("对于"), F.lit("就")), F.lit("对照"), F.lit("比照"))
    out = once(rows, **{known: own, source: normal})
    if grammar >= 4:
        # A bare 合同 right after a named contract is that contract.
        said = lambda n: F.regexp_like(F.col(source), F.concat(F.lit("\\Q"), n, F.lit(r"\E(?:的)?(?:签订|审核|审批|履行)(?:以及|及|和|与|、该)合同(?=的|准确|完整|真实)")))
        again = F.filter(F.col(allowed), lambda n: (F.length(n) > 2) & n.endswith("合同") & said(n))
        bare = (F.size(again) == 1) & ~F.array_contains(allowed, "合同")
        out = out.withColumn(known, F.when(bare, F.concat(F.filter(known, lambda k: k["term"] != "合同"), F.array(pair(F.lit("合同"), F.get(again, F.lit(0)))))).otherwise(F.col(known)))
    alias = lambda x: F.coalesce(F.get(F.filter(known, lambda a: a["term"] == x), F.lit(0))["name"], x)
    named = F.concat(F.col(allowed), F.transform(known, lambda a: a["name"]), words)
    out = once(out, **{known: longest_first(F.concat(F.col(known), F.transform(F.filter(named, lambda n: ~F.exists(known, lambda a: a["term"] == n)), lambda n: pair(n, n))))})

    src, terms = F.col(read), F.col(known)
    if grammar >= 3:
        # A quoted rule that the row acts by is no carrier, unless it is allowed.
        basis = occurrences(F.col(source), rf"(?<=按照|依据|根据|依照){QUOTED}(?=(?:的)?(?:规定|要求|执行|开展))")
        masked = left_over(F.col(source), F.filter(basis, lambda m: ~F.array_contains(allowed, alias(F.substr(m["text"], F.lit(2), F.length(m["text"]) - 2)))), "制度依据")
        out = once(out, **{read: masked})
    else:
        out = out.withColumn(read, F.col(source))

    patterns = (RESPONSIBILITY_OBJECT if grammar == 1 else CLAUSE_OBJECT, ACTION_OBJECT)
    objects = F.filter(F.transform(F.concat(*(F.regexp_extract_all(src, F.lit(p), 1) for p in patterns)), _stripped), lambda o: o != "")
    judged = F.transform(objects, lambda o: F.struct(o.alias("object"), claimed(F.regexp_replace(o, QUOTED, ""), terms, _plain).alias("spans")))
    rest = lambda j: F.regexp_replace(_stripped(left_over(F.regexp_replace(j["object"], QUOTED, ""), j["spans"])), "^[、，,及和与的]+|[、，,及和与的]+$", "")
    out = once(out, **{parts: judged})
    out = once(out, **{parts: F.transform(parts, lambda j: j.withField("rest", rest(j)))})
    fragment = lambda r: r.rlike(FRAGMENT_STARTS) if grammar > 1 else F.lit(False)
    unlisted = lambda j: j["rest"].rlike(DOCUMENT_ENDINGS) & ~j["rest"].rlike(ACTION_STARTS) & ~j["rest"].rlike("及|和|与") & ~fragment(j["rest"])
    open_parts = F.filter(parts, lambda j: (j["rest"] != "") & ~_behaves(j["rest"]))
    new = F.transform(F.filter(open_parts, unlisted), lambda j: j["rest"])
    unread = F.array_distinct(F.transform(F.filter(open_parts, lambda j: ~unlisted(j)), lambda j: j["object"]))
    refs = F.concat(F.transform(F.regexp_extract_all(src, F.lit(QUOTED), 1), alias), F.flatten(F.transform(parts, lambda j: _names(j["spans"]))))
    if grammar >= 2:
        refs = F.concat(refs, _names(claimed(src, terms, _plain)))
    if grammar >= 3:
        refs = F.concat(refs, _names(claimed(src, terms, _acts)))
    new_names, unread_names, found = (f"_{name}_{k}" for k in ("new", "unread", "found"))
    out = once(out, **{new_names: F.array_distinct(new), unread_names: unread, found: refs})
    if grammar < 3:
        out = once(out, **{found: F.concat(found, F.transform(new_names, alias))})
    else:
        out = _leftovers(out, terms, new_names, unread_names, found, alias, grammar)
    if grammar == 5:
        out = _repaired(out, text, new_names, unread_names, found, alias)
    references = F.array_sort(F.array_distinct(found))
    beyond = F.array_except(references, F.col(allowed))
    matched = F.lit("matched") if grammar == 5 else F.when(F.size(references) > 0, "matched").otherwise("not_applicable")
    status = F.when(F.col(source) == "", "not_applicable").when(F.size(unread_names) > 0, "unavailable").when(F.size(beyond) > 0, "unresolved").otherwise(matched)
    facts = F.struct(references.alias("references"), beyond.alias("unresolved"), F.col(unread_names).alias("unavailable"), status.alias("status"))
    return once(out, **{name: facts}).drop(known, source, read, parts, new_names, unread_names, found)


def _leftovers(out: DataFrame, terms: Column, new: str, unread: str, found: str, alias: Callable[[Column], Column], grammar: int) -> DataFrame:
    """Grammars 3 and up: unlisted documents and unread fragments that known names cover, and what an act leaves open."""
    covered = F.transform(F.col(new), lambda n: F.struct(n.alias("text"), unique_cover(n, terms).alias("cover")))
    read = F.transform(F.col(unread), lambda f: F.struct(f.alias("text"), unique_cover(f, terms).alias("cover"), claimed(f, terms, *([_acts] if grammar == 3 else [_acts, _data])).alias("spans")))
    out = once(out, **{new: covered, unread: read})
    said = F.transform(F.filter(new, lambda n: n["cover"].isNull()), lambda n: n["text"])
    act_names = F.filter(said, lambda n: n.rlike(ACT_AS_NAME)) if grammar >= 4 else F.array().cast(_NAMES)
    names = F.concat(
        F.col(found),
        F.transform(F.array_except(said, act_names), alias),
        F.flatten(F.transform(F.filter(new, lambda n: n["cover"].isNotNull()), lambda n: n["cover"])),
        F.flatten(F.transform(unread, lambda f: F.coalesce(f["cover"], _names(f["spans"])))),
    )
    loose = F.filter(unread, lambda f: f["cover"].isNull())
    rest = lambda f: left_over(f["text"], f["spans"], " ")
    act = lambda r: r.rlike(CONTROL_ACTION) & ~r.rlike(DOCUMENT_CUE)
    if grammar == 3:
        return once(out, **{found: names, unread: F.transform(F.filter(loose, lambda f: ~act(rest(f))), lambda f: f["text"])})

    def remainder(f: Column) -> Column:
        r = F.when(F.size(f["spans"]) > 0, F.regexp_replace(rest(f), "等(?:相关)?(?:资料|材料|单据|信息)(?:中|内|上)?", "")).otherwise(rest(f))
        return F.regexp_replace(F.regexp_replace(r, "(?:进行|开展|组织|核对|审核|确认|初审|注明|涉及)+$", ""), r"\s", "")

    def plain(r: Column) -> Column:
        r = F.regexp_replace(r, "^[的中内上、,;及和与]+|[的中内上、,;及和与]+$", "")
        return (r == "") | F.forall(F.split(r, "[、,;]|及|和|与|的"), lambda p: (p == "") | p.rlike(NON_DOCUMENT)) | act(r)

    # An enumeration of attributes of one document, and a document that something stands in.
    attributed = lambda r, k: F.regexp_extract(r, "^(.+?)等(.+?)(?:的)?(?:关键)?(?:信息|内容|条款)$", k)
    holds = lambda r: (attributed(r, 2) != "") & plain(attributed(r, 1)) & (F.exists(terms, lambda t: t["term"] == attributed(r, 2)) | (attributed(r, 2).rlike(DOCUMENT_END) & ~attributed(r, 2).rlike("[、,;及和与]|确认|按照|使用")))
    placed = lambda r: F.regexp_extract(r, "^(.{2,80}?)(?:中|上|内)(?:的)?$", 1)
    inside = lambda r: (placed(r) != "") & placed(r).rlike(DOCUMENT_END) & ~placed(r).rlike("[、,;及和与]|确认|提交|按照")
    out = once(out, **{found: names, new: act_names, unread: F.transform(loose, lambda f: F.struct(f["text"].alias("text"), remainder(f).alias("rest"), act(rest(f)).alias("acts")))})
    # What grammar 3 takes for an act stays one, but for an act about a rule.
    ruled = lambda f: f["acts"] & f["text"].rlike("制度|办法|条例")
    rule = lambda f: F.regexp_extract(f["text"], POLICY, 1)
    named_rule = lambda f: ruled(f) & (rule(f) != "") & ~rule(f).rlike("按照|依据|根据|[、,;及和与]")
    more = F.concat(
        F.col(found),
        F.transform(F.filter(unread, named_rule), lambda f: alias(rule(f))),
        F.transform(F.filter(unread, lambda f: ~f["acts"] & holds(f["rest"])), lambda f: alias(attributed(f["rest"], 2))),
        F.transform(F.filter(unread, lambda f: ~f["acts"] & ~holds(f["rest"]) & inside(f["rest"])), lambda f: alias(placed(f["rest"]))),
    )
    dark = F.filter(unread, lambda f: (ruled(f) & ~named_rule(f)) | (~f["acts"] & ~holds(f["rest"]) & ~inside(f["rest"]) & ~plain(f["rest"])))
    return once(out, **{found: more, unread: F.concat(F.col(new), F.transform(dark, lambda f: f["text"]))})


def _repaired(out: DataFrame, text: str, new: str, unread: str, found: str, alias: Callable[[Column], Column]) -> DataFrame:
    """Grammar 5: accounts that a contract names, complete acts, and attributes of an order named before."""
    contract = lambda f: F.regexp_extract(f, CONTRACT_ACCOUNT, 1)
    paid = lambda f: (contract(f) != "") & ~contract(f).rlike("不|未|无|禁止|不得")
    before = lambda f: F.split_part(F.col(text), F.concat(F.lit("对"), f), F.lit(1))
    orders = lambda f: F.size(F.filter(F.array_distinct(F.col(found)), lambda n: n.endswith("订单") & F.contains(before(f), n)))
    more = F.concat(F.col(found), F.transform(F.filter(unread, paid), lambda f: alias(contract(f))))
    dark = F.filter(unread, lambda f: ~paid(f) & ~f.rlike(COMPLETE_ACT) & ~(f.rlike(ORDER_ATTRIBUTES) & (orders(f) == 1)))
    return once(out, **{found: more, unread: dark})
