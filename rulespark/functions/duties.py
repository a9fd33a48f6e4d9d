"""What a duty says about responsibility: statements, who makes them, and what denies them.

A normalised text is read as an ordered sequence of statements, each a predicate
that assumes a responsibility with the words before it.  ``with_facts`` folds
over the predicates in order, carrying the end of the last one, and then
marks each statement: denied, quoted, delegated, somebody else's, taken back
later, or of unclear scope.  Everything is an expression over the columns of
the row; offsets are characters of the normalised text.

Grammars: 1 reads predicates, denials, quotations and delegation; 2 also
actors, later denials, parallel and broken sentences; 3 also modal denials,
named actors and what can't be decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grammar of responsibility clauses.
MODIFIER = r"(?:直接|全面|共同|分别|相应|主要|全部|首要|一定|初审|最终|[一二三四五]级)*"
PREDICATE = rf"(?:负有?|承担|担负|具有|有|履行|落实){MODIFIER}(?:(?:主体|审核|审批|复核){MODIFIER})?责任|(?:负有?|承担|担负)[^。;；!?！？责任]{{1,120}}的(?:主体|审核|审批|复核)责任|负责(?![一-鿿])"
PREDICATE_OBJECT = r"^(?:负有?|承担|担负)([^。;；!?！？责任]{1,120}的)(?:主体|审核|审批|复核)责任$"
TYPED = rf"(主体|审核|审批|复核){MODIFIER}责任"
NEGATIVE = r"(?:不|未|没|无需|无须|不必|不得|不能|不需要|免于|没有)(?:再|直接)?$|(?:无需|无须|不必|不需要|免于|不)对[^。;；]*$"
DELEGATED = r"(?:督促|监督|指导|检查|要求|协助)[^,，。;；]{0,40}(?:承担|履行|落实)"
QUOTATION = r"“[^”]*”|「[^」]*」|\"[^\"\n]*\""
STOPS = "。;；!?！？"
TECHNICAL_NOUNS = r"技术规范书|技术规范(?!性)|规范性文件"
INVOICE_CHECK = r"发票验真|(?:核验|验证|查验)发票真伪"
OBJECT_FILLERS = r"[的对、,，及和与\s]"
COMPLETE_WORDS = ("完备性", "完备", "齐全")

# Actors, later denials, parallel and broken sentences of grammar 2.
LOCAL_ACTORS = ("本岗位", "本人", "本部门")
ACTOR = r"(?:^|[,，])(?:由)?(?:本岗位|本人|本部门|供应商|承包商|其他部门|其他岗位|他人|第三方)(?=对|负责|应|需|承担|负|不)"
DENIAL = r"(?:本岗位|本人|本部门)(?:并)?(?:不|无需|无须|不必|不需要)(?:再)?(?:承担|负有|负|履行)(?:上述|前述|该项|该|这些|任何|全部|主体|审核|审批)?责任"
NOMINAL_REQUIREMENT = r"(?:管理|技术|合同|制度|规范|标准)要求(?:的)?落实(?:情况|效果)"
BROKEN_SENTENCE = r"负进行(?:复核|审核)|(?:主体|审核|审批)在责任|付(?:全面|主体|审核|审批)责任"
ACTOR_SWITCH = r"[;；](?:本岗位|本人|本部门)|由(?:供应商|承包商|其他部门|他人)|(?:供应商|承包商|其他部门|他人)(?:负责|承担|保证|处理)"
SPLIT_OBJECT = r"(对[^。;；!?！？]{2,100})。(?=(?:负有?|承担|具有)(?:主体|审核|审批)责任)"
ACTION_NOT_QUALITY = r"规范(?=管理|自付单据|会议组织|会议报销|做好报销)"
MALFORMED = r"(?:负有?|承担)(?:主体|审核|审批)在责任|付(?:全面|主体|审核|审批)责任|负进行(?:复核|审核)"
BARE_TYPE = r"[^。;；]*?(?:主体|审核|审批)责任(?=[。;；]|$)"
ASSUMED_IN_BARE = r"承担|负|具有|有.*责任|履行|落实.*责任|责任[:：]"
ASSURANCE = r"^[,，](?:并)?(?:确保|保证|保障)(.+)$"
ASSURANCE_UNCERTAIN = r"是否|可能|待核实|待确认|由.*(?:部门|供应商)"
ASSURANCE_DENIED = r"不|未|无需|无法"
MATCHING_OBJECT = r"^(?:本岗位)?对匹配(?:的)?准确性$"

# Modal denials, named actors and unclear scopes of grammar 3.
MODAL = r"(?:不(?:应当|应该|应|需要|必|用|再|能|会|愿)?|无需|无须|免于|未曾|从未|未尝|未能)"
OPENING = r"(?:^|[,，]|(?<=责任)(?=然而|而|但|并|且))(?:然而|而|但|并|且)?"
OPENING_WORDS = r"^[,，]?(?:然而|而|但|并|且)?"
#: The denial and the name of an actor, and what follows them.
KNOWN_ACTOR = (r"(并非|不是)?(?:由)?(本岗位|本人|本部门|供应商|承包商|其他部门|其他岗位|其他人员|其他单位|他人|第三方)", r"(?=对|负责|应|需|承担|负|不|未)")
APPOINTED_ACTOR = (r"(并非|不是)?由([^对,，。;；!?！？]{1,30}?)", r"(?=对|(?:应当|应该|应|需|不)?(?:负有?|承担|担负|具有|履行|落实))")
SUBJECT_ACTOR = (r"(并非|不是)?(?:由)?([^对,，。;；!?！？]{0,25}(?:人员|单位|部门|岗位|公司|相关方|承担方|部))", r"(?=对|负责|应|需|承担|负|不|未)")
OTHER_ACTORS = ("供应商", "承包商", "他人", "第三方", "相关方")
MODAL_DENIAL = r"(?:本岗位|本人|本部门)(?:并)?" + MODAL + r"(?:再)?(?:承担|负有?|履行)(?:上述|前述|该项|该|这些|任何|全部|主体|审核|审批)?责任"
MODAL_BEFORE = MODAL + r"(?:再|直接)?$"
NAMELESS_ACTOR = OPENING + r"[^对,，。;；]{0,25}(?:人员|单位|部门|岗位|公司|相关方)$"
UNCERTAIN_SCOPE = r"是否|可能|不一定|并非"
DOUBLE_NEGATIVE = r"(?:并非|不是)[^,，。;；]{0,30}(?:不|未|没有|无需|无须)"

#: Stands for every character of a quotation, and brackets a hit.
_QUIET, _OPEN, _CLOSE = "\ue000", "\ue001", "\ue002"
_SPANS = "array<struct<start:int,end:int,text:string>>"


def _part(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def occurrences(text: Column, pattern: str | Column) -> Column:
    """The matches of a pattern from left to right: array<struct<start, end, text>>, offsets from 0."""
    pieces = F.split(F.regexp_replace(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(f"{_OPEN}$0{_CLOSE}")), _CLOSE, -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))

    def step(state: Column, piece: Column) -> Column:
        before = F.substring_index(piece, _OPEN, 1)
        start = state["at"] + F.length(before)
        hit = F.substr(piece, F.length(before) + 2)
        own = F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("text"))
        # Only the last piece, what follows the last hit, has no opening mark.
        return F.when(F.contains(piece, F.lit(_OPEN)), F.struct(own["end"].alias("at"), F.concat(state["found"], F.array(own)).alias("found"))).otherwise(state)

    return F.aggregate(pieces, begin, step)["found"]


def without_quotations(text: Column) -> Column:
    """The text with every character of a quotation replaced, so that offsets stay."""
    parts = F.regexp_extract_all(text, F.lit(rf"({QUOTATION}|[^“「\"]+|[“「\"])"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^(?:{QUOTATION})$"), F.repeat(F.lit(_QUIET), F.length(p))).otherwise(p)), "")


def _quoted(quiet: Column, at: Column) -> Column:
    return _part(quiet, at, at + 1) == _QUIET


def joined_sentences(text: Column) -> Column:
    """The text with stops that stand within one statement turned into commas; offsets stay."""
    split = F.regexp_replace(text, SPLIT_OBJECT, f"$1{_CLOSE}")

    def joined(sentence: Column) -> Column:
        predicates = F.regexp_extract_all(sentence, F.lit(f"({PREDICATE})"), 1)
        types = lambda t: F.size(F.regexp_extract_all(t, F.lit(TYPED), 1))
        one = sentence.startswith("对") & (F.size(predicates) == 1) & (types(F.get(predicates, F.lit(0))) == types(sentence)) & ~sentence.rlike(BROKEN_SENTENCE) & ~sentence.rlike(ACTOR_SWITCH)
        before = F.substring_index(F.regexp_replace(sentence, PREDICATE, f"{_OPEN}$0"), _OPEN, 1)
        return F.when(one, F.concat(F.regexp_replace(before, "[;；]", ","), F.substr(sentence, F.length(before) + 1))).otherwise(sentence)

    sentences = F.regexp_extract_all(split, F.lit(f"([^。!?！？{_CLOSE}]+|[。!?！？{_CLOSE}])"), 1)
    whole = F.translate(F.array_join(F.transform(sentences, joined), ""), _CLOSE, ",")
    return F.regexp_replace(whole, ACTION_NOT_QUALITY, "··")


def quality_words(attributes: list[str]) -> list[str]:
    """The words that state an attribute: with and without 性, and those for completeness."""
    words = {*attributes, *(a[:-1] for a in attributes if a.endswith("性"))}
    if "完整性" in words:
        words |= set(COMPLETE_WORDS)
    return sorted(words, key=lambda w: (-len(w), w))


def _either(words: list[str]) -> str:
    return "|".join(f"\\Q{w}\\E" for w in words)


def _qualities(text: Column, words: list[str]) -> Column:
    """The quality words of a text, those within technical nouns and a leading verb left out."""
    if not words:
        return F.array().cast("array<string>")
    text = F.regexp_replace(text, TECHNICAL_NOUNS, "··")
    found = F.regexp_extract_all(text, F.lit(f"({_either(words)})"), 1)
    return F.when(F.regexp_extract(text, f"^(?:{_either(words)})", 0) == "规范", F.slice(found, 2, F.greatest(F.size(found), F.lit(1)))).otherwise(found)


def _typed(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TYPED), 1), lambda t: F.concat(t, F.lit("责任")))


def _statements(text: Column) -> Column:
    """The fold: a statement begins after the last stop or the statement before it."""
    begin = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<start:int,at:int,end:int,predicate:string>>").alias("found"))

    def step(state: Column, hit: Column) -> Column:
        words = F.regexp_extract(_part(text, state["last"], hit["start"]), f"[^{STOPS}]*$", 0)
        own = F.struct((hit["start"] - F.length(words)).alias("start"), hit["start"].alias("at"), hit["end"].alias("end"), hit["text"].alias("predicate"))
        return F.struct(hit["end"].alias("last"), F.concat(state["found"], F.array(own)).alias("found"))

    return F.aggregate(occurrences(text, PREDICATE), begin, step)["found"]


def _denials(text: Column, quiet: Column, pattern: str) -> Column:
    """array<struct<start, end, role>> of the denials that are not quoted; a denial of no type in particular has a null role."""
    own = F.filter(occurrences(text, pattern), lambda d: ~_quoted(quiet, d["start"]))
    role = lambda d: F.regexp_extract(d["text"], r"(主体|审核|审批)责任$", 0)
    return F.transform(own, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), F.when(role(d) != "", role(d)).alias("role")))


def _taken_back(statement: Column, denials: Column) -> Column:
    return F.exists(denials, lambda d: (d["start"] >= statement["end"]) & (d["role"].isNull() | F.coalesce(F.array_contains(statement["roles"], d["role"]), F.lit(False))))


def _extended(statements: Column, more) -> Column:
    """Every statement with further or replaced fields."""

    def one(s: Column) -> Column:
        for name, value in more(s).items():
            s = s.withField(name, value)
        return s

    return F.transform(statements, one)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further or replaced columns, each computed once a row.

    A generator of one row stands between: what reads the columns, filters
    included, is otherwise planned with their expressions written out at
    every mention.
    """
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.explode_outer(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))).alias("_once")).select(*kept, *(F.col(f"_once.{k}").alias(k) for k in columns))


def with_facts(rows: DataFrame, text: str, attributes: list[str], grammar: int, name: str = "_facts") -> DataFrame:
    """``rows`` with what the normalised column ``text`` says (null counts as empty), as a struct ``name``.

    statements: array of (start, at, end, predicate, roles, qualities,
    object_present, negative, quoted, delegated, other_actor, taken_back,
    unlinked, unresolved); qualities and mentioned: the quality words and types of
    the whole text; malformed: whether a predicate is broken.
    """
    words = quality_words(attributes)
    source, quiet, read, found, denied = (f"_{name}_{k}" for k in ("source", "quiet", "read", "found", "denied"))
    src, dim = F.col(source), F.col(quiet)
    out = once(rows, **{source: F.translate(F.coalesce(F.col(text), F.lit("")), _QUIET + _OPEN + _CLOSE, "")})
    out = once(out, **{quiet: without_quotations(src), read: src if grammar == 1 else joined_sentences(src)})
    out = once(out, **{found: _statements(F.col(read))})
    mentioned, stated = _typed(F.col(read)), _qualities(F.col(read), words)

    def first(s: Column) -> dict[str, Column]:
        prefix = _part(F.col(read), s["start"], s["at"])
        body = F.concat(prefix, F.regexp_extract(s["predicate"], PREDICATE_OBJECT, 1))
        own = F.regexp_replace(F.regexp_replace(body, _either(words), "") if words else body, OBJECT_FILLERS, "")
        invoice = F.lit("真实性" in attributes) & body.rlike(INVOICE_CHECK)
        linked = _qualities(body, words)
        return {
            "roles": _typed(s["predicate"]),
            "qualities": F.when(invoice, F.concat(linked, F.array(F.lit("真实性（发票验真）")))).otherwise(linked),
            "object_present": F.length(own) >= 2,
            "negative": prefix.rlike(NEGATIVE),
            "quoted": _quoted(dim, s["at"]),
            "delegated": F.concat(prefix, s["predicate"]).rlike(DELEGATED),
            "other_actor": F.lit(False),
            "taken_back": F.lit(False),
            "unlinked": F.lit(False),
            "unresolved": F.array().cast("array<string>"),
        }

    out = once(out, **{found: _extended(F.col(found), first)})
    malformed = F.lit(False)
    if grammar > 1:
        out = once(out, **{denied: _denials(src, dim, DENIAL)})
        out = once(out, **{found: _extended(F.col(found), lambda s: _second(s, src, dim, F.col(denied), attributes))})
        broken = F.exists(occurrences(src, MALFORMED), lambda m: ~_quoted(dim, m["start"]))
        bare = F.exists(occurrences(src, BARE_TYPE), lambda m: ~_quoted(dim, m["end"] - 3) & ~m["text"].rlike(ASSUMED_IN_BARE))
        malformed = broken | ((F.size(found) == 0) & (F.size(mentioned) > 0) & bare)
    if grammar > 2:
        out = once(out, **{found: _extended(F.col(found), lambda s: {"_actor": _actor(s, src, dim)})})
        out = once(out, **{found: _extended(F.col(found), lambda s: _third(s, src, dim))})
        own = F.filter(F.col(found), lambda s: s["negative"] & (F.size(s["unresolved"]) == 0) & ~s["quoted"] & ~s["other_actor"])
        said = F.flatten(F.transform(own, lambda s: F.transform(s["roles"], lambda r: F.struct(s["start"].alias("start"), s["end"].alias("end"), r.alias("role")))))
        all_denials = F.array_union(F.array_union(F.col(denied), _denials(src, dim, MODAL_DENIAL)), said)
        unclear = F.filter(F.col(found), lambda s: F.size(s["unresolved"]) > 0)
        out = once(out, **{denied: F.filter(all_denials, lambda d: ~F.exists(unclear, lambda s: (s["start"] <= d["start"]) & (d["start"] < s["end"])))})
        out = once(out, **{found: _extended(F.col(found), lambda s: {"taken_back": _taken_back(s, F.col(denied))})})
    facts = F.struct(F.col(found).alias("statements"), stated.alias("qualities"), mentioned.alias("mentioned"), malformed.alias("malformed"), src.alias("text"))
    return once(out, **{name: facts}).drop(source, quiet, read, found, denied)


def _second(s: Column, src: Column, quiet: Column, denials: Column, attributes: list[str]) -> dict[str, Column]:
    """What grammar 2 adds: delegation apart from nominal requirements, the last actor, later denials, qualities after the predicate."""
    prefix = _part(src, s["start"], s["at"])
    actors = F.filter(occurrences(prefix, ACTOR), lambda m: ~_quoted(quiet, s["start"] + m["start"]))
    actor = F.regexp_replace(F.coalesce(F.try_element_at(actors, F.lit(-1))["text"], F.lit("")), "^[,，]?由?", "")
    more = {
        "delegated": F.concat(F.regexp_replace(prefix, NOMINAL_REQUIREMENT, "·"), s["predicate"]).rlike(DELEGATED),
        "other_actor": (actor != "") & ~actor.isin(*LOCAL_ACTORS),
        "taken_back": _taken_back(s, denials),
    }
    if attributes:
        words = sorted(({*attributes, *(a[:-1] for a in attributes if a.endswith("性"))}) - {"规范", "匹配"}, key=lambda w: (-len(w), w))
        after = F.regexp_extract(F.substr(src, s["end"] + 1), f"^[^{STOPS}]*", 0)
        assured = F.regexp_extract(after, ASSURANCE, 1)
        named = F.regexp_extract_all(assured, F.lit(f"({_either(words)})"), 1) if words else F.array().cast("array<string>")
        doubt = assured.rlike(ASSURANCE_UNCERTAIN)
        if words:
            doubt = doubt | F.exists(F.split(assured, "[、,，]"), lambda x: x.rlike(_either(words)) & x.rlike(ASSURANCE_DENIED))
        qualities = F.when(doubt, s["qualities"]).otherwise(F.concat(s["qualities"], named))
        matching = ~s["object_present"] & prefix.rlike(MATCHING_OBJECT) & F.lit("准确性" in attributes)
        more |= {"qualities": F.when(matching, F.array_remove(qualities, "匹配")).otherwise(qualities), "unlinked": doubt & (F.size(named) > 0), "object_present": s["object_present"] | matching}
    return more


def _actor(s: Column, src: Column, quiet: Column) -> Column:
    """The last actor named in the sentence up to the predicate: struct(start, short, name, denied); null without one."""
    words = F.regexp_extract(_part(src, F.lit(0), s["at"]), f"[^{STOPS}]*$", 0)
    base = s["at"] - F.length(words)
    said = F.concat(words, s["predicate"])

    def named(body: str, after: str) -> Column:
        found = F.filter(occurrences(said, OPENING + body + after), lambda m: ~_quoted(quiet, base + m["start"]))
        part = lambda m, k: F.regexp_extract(m["text"], f"{OPENING_WORDS}{body}$", k)
        return F.transform(found, lambda m: F.struct((base + m["start"]).alias("start"), (-F.length(part(m, 2))).alias("short"), part(m, 2).alias("name"), (part(m, 1) != "").alias("denied")))

    # Of actors that begin at one place the shortest counts: a pattern of units would take a denial for a part of the name.
    return F.array_max(F.concat(*(named(*actor) for actor in (KNOWN_ACTOR, APPOINTED_ACTOR, SUBJECT_ACTOR))))


def _third(s: Column, src: Column, quiet: Column) -> dict[str, Column]:
    """What grammar 3 adds: whose statement it is, modal denials, and why its scope is unclear."""
    actor = s["_actor"]
    direct = F.coalesce(actor["start"] >= s["start"], F.lit(False))
    others = actor["name"].isin(*OTHER_ACTORS) | actor["name"].startswith("其他")
    prefix = _part(src, s["start"], s["at"])
    negative = s["negative"] | (direct & F.coalesce(actor["denied"], F.lit(False))) | prefix.rlike(MODAL_BEFORE)
    scope = _part(quiet, F.when(direct, actor["start"]).otherwise(s["start"]), s["at"])
    unclear = [
        F.when(scope.rlike(UNCERTAIN_SCOPE) & ~negative, "uncertain_expression"),
        F.when(scope.rlike(DOUBLE_NEGATIVE), "double_negative"),
        F.when(actor.isNotNull() & ~actor["name"].isin(*LOCAL_ACTORS) & ~others, "actor_identity"),
        F.when(prefix.rlike(NAMELESS_ACTOR) & ~direct, "actor_scope"),
    ]
    return {"other_actor": F.when(actor.isNotNull(), others).otherwise(s["other_actor"]), "negative": negative, "unresolved": F.array_compact(F.array(*unclear))}


def own_statements(facts: Column, resolved: bool = False) -> Column:
    """The statements that stand: not denied, quoted, delegated, somebody else's or taken back (``resolved``: and of clear scope)."""
    own = F.filter(facts["statements"], lambda s: ~(s["negative"] | s["quoted"] | s["delegated"] | s["other_actor"] | s["taken_back"]))
    return F.filter(own, lambda s: F.size(s["unresolved"]) == 0) if resolved else own


def contradicts_itself(facts: Column) -> Column:
    return F.exists(facts["statements"], lambda s: s["taken_back"] & ~(s["negative"] | s["quoted"] | s["delegated"] | s["other_actor"]))


def only_of_others(facts: Column) -> Column:
    return F.exists(facts["statements"], lambda s: s["other_actor"] & ~s["quoted"]) & (F.size(own_statements(facts)) == 0)


def unresolved(facts: Column) -> Column:
    return F.exists(facts["statements"], lambda s: F.size(s["unresolved"]) > 0)


def assumed(facts: Column, resolved: bool = False) -> Column:
    """The responsibility types that the row itself assumes."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(own_statements(facts, resolved), lambda s: s["roles"]))))


def beyond_statements(facts: Column) -> Column:
    """Types that the text mentions outside every statement."""
    return F.array_except(facts["mentioned"], F.flatten(F.transform(facts["statements"], lambda s: s["roles"])))
