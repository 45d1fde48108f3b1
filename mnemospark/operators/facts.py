"""Rule-based facts from short statements in seven languages.

A statement is cut into sentences and clauses. Questions, guesses, plans and suppositions are
not asserted and give nothing. Each clause has a subject (who it is about), a change type from
its markers, and values that patterns of nine attributes find. ``from A to B`` forms give two
facts, the historical and the new one. Rules are tables of patterns; the code is one loop.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT = "struct<subject:string,subject_key:string,attribute:string,value:string,canonical_value:string,value_kind:string,change_type:string,confidence:int>"

#: Attribute, confidence, kind of value; in the order they are tried.
ATTRIBUTES = {
    "schedule": (70, "datetime_like"), "residence": (90, "city"), "preference": (85, "freeform"),
    "employment": (85, "organization_name"), "relationship": (80, "person_name"), "status": (75, "title"),
    "contact": (80, "freeform"), "ownership": (75, "asset_name"), "skill": (75, "skill_name"),
}
LISTS = ("preference", "skill", "ownership")

_V = "(?P<v>.+)"
#: What comes before (or around) a value; the first pattern of an attribute that fits counts.
PATTERNS = {
    "schedule": [
        rf"\b(?:call|meeting|appointment|interview|flight|lunch|dinner)\s+(?:is|was|has been|got)?\s*(?:now|moved|rescheduled|scheduled|set|changed)?\s*(?:to|at|for|on)\s+{_V}",
        rf"(?:会议|会面|面试|约会|航班|电话会)(?:改到|改成|改为|定于|定在|安排在|推迟到|提前到|在){_V}",
        rf"\b(?:reunión|cita)\s+es\s+(?:a|el)\s+{_V}", rf"(?:会議|打ち合わせ)は{_V}",
    ],
    "residence": [
        rf"\b(?:lives?|living|lived|resides?|based|located)\s+in\s+{_V}", rf"\bmoved\s+to\s+{_V}",
        rf"(?:住在|居住在|定居在|搬到了?|搬去了?|位于){_V}", rf"\bviv[eo]\s+en\s+{_V}", rf"\b(?:habite|vis|vit)\s+à\s+{_V}",
        rf"\b(?:wohn|leb)(?:e|t)\s+in\s+{_V}", rf"\b(?:mor[oa]|viv[oe])\s+em\s+{_V}", r"(?P<v>[^は、。]+?)に(?:住んで|住みます)",
    ],
    "preference": [
        rf"\b(?:likes?|loves?|enjoys?|prefers?|dislikes?|hates?)\s+{_V}", rf"(?:喜欢|爱吃|爱喝|偏好|讨厌){_V}",
        rf"\b(?:me\s+gustan?|me\s+encantan?|prefiero|le\s+gustan?)\s+{_V}", rf"\b(?:aime|préfère|adore)\s+{_V}",
        rf"\b(?:mag|liebe|bevorzuge)\s+{_V}", rf"\b(?:gosto\s+de|adoro|prefiro)\s+{_V}", r"(?P<v>[^は、。]+?)が(?:好き|嫌い)",
    ],
    "employment": [
        rf"\b(?:works?|working|worked)\s+(?:at|for)\s+{_V}", rf"\b(?:employed\s+(?:at|by)|joined)\s+{_V}", r"在(?P<v>.+?)(?:工作|上班|任职)", rf"(?:就职于|任职于|加入了?){_V}",
        rf"\btrabaj[oa]\s+(?:en|para)\s+{_V}", rf"\btravaille\s+(?:chez|pour)\s+{_V}", rf"\barbeitet?\s+(?:bei|für)\s+{_V}",
        rf"\btrabalh[oa]\s+(?:na|no|em|para)\s+{_V}", r"(?P<v>[^は、。]+?)で(?:働|勤務)",
    ],
    "relationship": [
        rf"\b(?:engaged\s+to|married\s+to|dating)\s+{_V}", rf"\bmy\s+(?:wife|husband|partner|brother|sister|mother|father|girlfriend|boyfriend|fiancée?|boss)(?:'s\s+name)?\s+is\s+{_V}",
        rf"(?:老婆|妻子|丈夫|老公|女朋友|男朋友|女友|男友|伴侣)(?:是|叫){_V}", r"(?:和|跟)(?P<v>.+?)(?:结婚|交往|恋爱)",
    ],
    "status": [
        rf"\bworks?\s+as\s+{_V}", rf"\b(?:I\s+am|I'm)\s+(?=an?\s|the\s){_V}", r"^(?:我|他|她|你)?(?:现在)?是(?:一名|一位|一个)?(?P<v>[^的，。]{2,12})$",
        rf"\bsoy\s+{_V}", rf"\bje\s+suis\s+{_V}", rf"\bich\s+bin\s+{_V}", rf"\bsou\s+{_V}",
    ],
    "contact": [
        rf"\b(?:e-?mail|phone|number|contact)(?:\s+(?:address|number))?\s+is\s+{_V}", rf"(?:邮箱|邮件|电话|手机号?|联系方式)(?:号码)?(?:是|为|[：:]){_V}", rf"联系我\s*[：:]\s*{_V}",
        rf"\b(?:correo|teléfono)\s+es\s+{_V}", rf"\b(?:e-?mail|téléphone)\s+est\s+{_V}", rf"\b(?:e-?mail|telefonnummer)\s+ist\s+{_V}",
        rf"\b(?:e-?mail|telefone)\s+é\s+{_V}", rf"(?:メール|電話)(?:アドレス|番号)?は\s*(?P<v>.+?)(?:です|$)",
    ],
    "ownership": [rf"\b(?:owns?|bought|sold)\s+(?:my\s+)?{_V}", rf"\bI\s+have\s+(?=an?\s){_V}", rf"(?:拥有|买了){_V}"],
    "skill": [
        rf"\b(?:speaks?|fluent\s+in|skilled\s+(?:in|at)|good\s+at|proficient\s+in|expert\s+in)\s+{_V}", rf"(?:擅长|精通|熟悉|会说){_V}", rf"\bhablo\s+{_V}", rf"\bje\s+parle\s+{_V}", rf"\bich\s+spreche\s+{_V}", rf"\bfalo\s+{_V}",
    ],
}
#: From an old value (``a``) to a new one (``b``).
TRANSITIONS = {
    "residence": [r"\bmoved\s+from\s+(?P<a>.+?)\s+to\s+(?P<b>.+)", r"从(?P<a>.+?)(?:搬到|搬去)了?(?P<b>.+)"],
    "contact": [r"\b(?:e-?mail|phone|number)\b.*?\bfrom\s+(?P<a>\S.*?)\s+to\s+(?P<b>.+)", r"(?:邮箱|电话|手机号?)从\s*(?P<a>.+?)\s*(?:改成|换成|改为|改到)\s*(?P<b>.+)"],
    "employment": [r"\bleft\s+(?P<a>.+?)\s+(?:to\s+join|for)\s+(?P<b>.+)", r"\b(?:switched|changed)\s+(?:jobs|employers|companies)\s+from\s+(?P<a>.+?)\s+to\s+(?P<b>.+)", r"从(?P<a>.+?)跳槽到(?P<b>.+)"],
}
# Words that mark a change, by type; the first type that fits counts.
CHANGES = [
    ("negation", r"\bno longer\b|\bnot\b|n't\b|\bnever\b|\banymore\b|\b(?:stopped|quit|left|cancell?ed|sold)\b|不再|不喜欢|不是|没有|没在|没住在|停止|离开|取消|卖掉|\bya no\b|\bno me gusta\b|\bne\b.*\b(?:plus|pas)\b|\bn['’].*\b(?:plus|pas)\b|\bj['’]aime pas\b|\bnicht\b|\bkein|\bn[ãa]o\b|ません|じゃない|\b(?:dislikes?|hates?)\b|讨厌|嫌い"),
    ("addition", r"\balso\b|\btoo\b|\bas well\b|\badditionally\b|\banother\b|还|也(?!许)|另外|\btambién\b|\baussi\b|\bauch\b|\btamb[ée]m\b"),
    ("update", r"\bnow\b|\bcurrently\b|\bmoved\b|\bchanged?\b|\bupdated\b|\bswitched\b|\brescheduled\b|\bjoined\b|\bbecame\b|现在|目前|刚刚|已经|如今|改成|改到|改为|换成|更新|搬到|搬去|加入|成为|\bahora\b|\bmaintenant\b|\bactuellement\b|\bd[ée]sormais\b|\bjetzt\b|\bderzeit\b|\bnun\b|\bagora\b|\batualmente\b|今は"),
    ("historical", r"\bused to\b|\bpreviously\b|\bformerly\b|\bbefore\b|\b(?:lived|worked)\b|之前|以前|曾经|过去|原来|\bantes\b|\bavant\b|\bauparavant\b|\bautrefois\b|\bfr[üu]her\b|\bvorher\b|\bantigamente\b|前は"),
]
_QUESTION = re.compile(r"^(?:(?:can|could|would|will|do|does|did|is|are|am|was|were|what|where|when|who|why|how|which)\s.*|.*[吗么呢]$)", re.I)
_GUESS = re.compile(r"\b(?:maybe|perhaps|might|probably|possibly|i think|i guess|quizás?|peut-être|vielleicht|talvez)\b|可能|也许|大概|应该会|かもしれ", re.I)
_FUTURE = re.compile(r"\b(?:will|i'll|we'll|he'll|she'll|they'll|going to|gonna|plans? to|planning to|want to|hope to)\b|准备|打算|计划|将会|将要|想去|会(?=搬|去|换|改|加入)|つもり", re.I)
_SUPPOSED = re.compile(r"^(?:if|suppose|supposing|imagine|for example|for instance|e\.g\.|as an example|let's say)\b|^(?:如果|假如|假设|要是|例如|比如|譬如|もし)", re.I)
_NOISE = re.compile(r"^(?:btw|by the way|actually|uh+|um+|well|so|ok(?:ay)?|hey|oh|fyi|quick (?:update|cleanup|note)|scratch that|update|不是|其实|对了|顺便说一下)(?:[\s,:，：]+|$)", re.I)
_ADVERB = r"(?:now|also|still|currently|no longer|used to|previously|formerly)"
_SENTENCE = re.compile(r"(?<=[。！？；;!?\n])|(?<=\.)(?=\s|$)")
# What clauses are cut at; words of addition stay with the clause they open.
_CLAUSE = re.compile(r"[,，、]\s*(?![0-9])|\s+(?:and|but|y|pero|et|mais|und|aber|e|mas)\s+|并且|而且|但是|同时|\s+(?=(?:also|también)\s)|(?<=.)(?=另外)")
_ORG = re.compile(r"(?:\b(?:Inc|Corp|Corporation|Ltd|LLC|GmbH|Labs?|Company|Group|University|Bank|Studio|Technologies|Systems)\.?|公司|集团|大学|银行|研究所|工作室)$")
_NAME = re.compile(r"^((?:[A-ZÀ-Þ][\w'’.-]*)(?:\s+[A-ZÀ-Þ][\w'’.-]*){0,3})\s+(?=[a-zà-ÿ])")
_CJK_NAME = re.compile(r"^(?!现在|之前|以前|曾经|如今)([一-鿿]{2,10}?)(?=现在|之前|以前|也|还|不再|住在|位于|喜欢|在.+?(?:工作|上班)|擅长|精通|老婆|妻子|丈夫|老公|的?邮箱|是(?:一名|一位))")
_NOT_NAMES = set("I I'm I've My The A An We Our You He She It They This That His Her Their There Also Now Currently Previously Before Then Antes Ahora Maintenant Avant Jetzt Früher Agora Can If Je J'habite J'aime Mon Ma Ich Meine Mein Vivo Mi Trabajo Me Moro Meu Trabalho Gosto Sou Soy Le La El Die Der Das 我 我们 他 她 你 会议 面试".split())
_SAID = re.compile(r"^(?P<who>.+?)\s*(?:\bsaid\b|\bsays\b|\bmentioned\b|\btold me\b|说)\s*(?:that\s+)?[:：,，]?\s*(?P<what>.+)$")
_FIRST = re.compile(r"\b(?:I|I'm|I've|my|me|mi|je|mon|ma|ich|meine?|meu|minha)\b|\bj['’]|我|私|^(?:vivo|trabajo|soy|hablo|moro|trabalho|sou|gosto|falo)\b", re.I)
_TEAM = re.compile(r"\b(?:we|our|us)\b|我们|咱们", re.I)
_TAIL = re.compile(r"(?:\s+(?:lol|haha|thanks|please|now|anymore|any more|too|as well|these days|currently|already))+$|(?:了|啦|吧|です|ます)$", re.I)
_EDGES = " \t'\"“”‘’「」《》()（）.,;:!?。，；：！？"
_ARTICLE = re.compile(r"^(?:a|an|the|un|une|una|ein|eine|um|uma)\s+|^(?:一名|一位|一个)", re.I)


def fragment(text: str) -> str:
    return re.sub(r"[\W_]+", "_", text.lower()).strip("_")


def canonical(attribute: str, value: str) -> str:
    low = " ".join(value.split()).lower()
    if attribute == "contact":
        digits = re.sub(r"\D", "", low)
        return low if "@" in low or len(digits) < 7 else digits
    if attribute == "schedule":
        low = low.replace("左右", "").replace("前后", "")
        low = re.sub(r"\b(?:tmrw|tmr)\b", "tomorrow", low).replace("2nite", "tonight")
        low = re.sub(r"^(?:at\s+)?(?:around|about|approximately|approx|roughly)\s+", "", low)
        low = re.sub(r"[- ]ish\b", "", low)
    if attribute == "preference":
        low = re.sub(r"^to\s+", "", _ARTICLE.sub("", low))
        return low.strip()
    return _ARTICLE.sub("", low).strip(" .,;!?'\"")


def value_kind(attribute: str, canon: str) -> str:
    if attribute == "contact":
        return "email" if "@" in canon else "phone" if len(re.sub(r"\D", "", canon)) >= 7 else "freeform"
    return ATTRIBUTES[attribute][1]


def change_of(clause: str, attribute: str) -> str:
    for change, marker in CHANGES:
        if re.search(marker, clause, re.I):
            return "contradiction" if change == "negation" and attribute == "preference" else change
    return "reaffirm"


def _trim(attribute: str, value: str) -> str:
    value = value.strip(_EDGES if attribute != "contact" else _EDGES.replace("(", ""))
    while (cut := _TAIL.sub("", value).strip(_EDGES if attribute != "contact" else " .,;!?\"'")) != value:
        value = cut
    return _ARTICLE.sub("", value) if attribute in ("status", "ownership") else value


def _named(name: str) -> tuple[str, str]:
    kind = "organization" if _ORG.search(name) else "external"
    return kind, f"{kind}:{fragment(name)}"


@lru_cache(None)
def _compiled() -> list[tuple[str, list[re.Pattern], list[re.Pattern]]]:
    build = lambda ps: [re.compile(p, re.I) for p in ps]
    return [(a, build(TRANSITIONS.get(a, [])), build(PATTERNS[a])) for a in ATTRIBUTES]


def _explicit(clause: str, domain: str, agent_id: str | None) -> tuple[str, str] | None:
    """Whom the clause itself says it is about."""
    if _TEAM.search(clause) or domain == "organization":
        return "organization", "organization:unknown"
    if domain == "agent" or agent_id:
        return "agent", f"agent:{fragment(agent_id)}" if agent_id else "agent:self"
    found = _CJK_NAME.match(clause) if re.match(r"[一-鿿]", clause) else _NAME.match(clause)
    if found and found[1] not in _NOT_NAMES and found[1].split()[0] not in _NOT_NAMES and not found[1].startswith(("我", "他", "她", "你", "会议", "面试")):
        return _named(found[1])
    return ("user", "user:self") if _FIRST.search(clause) else None


def detect(content: str | None, domain: str = "user", agent_id: str | None = None) -> list[dict]:
    """Facts of a statement, in the order found."""
    found: dict[tuple, dict] = {}
    carried: tuple[str, str] | None = None

    def add(subject, attribute, value, change, points):
        value = _trim(attribute, value)
        if not value:
            return
        if attribute == "schedule":
            subject = ("external", "external:unknown")
        canon = canonical(attribute, value)
        fact = {
            "subject": subject[0], "subject_key": subject[1], "attribute": attribute, "value": value, "canonical_value": canon,
            "value_kind": value_kind(attribute, canon), "change_type": change, "confidence": points,
        }
        old = found.setdefault((*subject, attribute, canon), fact)
        better = old["change_type"] == "reaffirm" != change or old["change_type"] == change and points > old["confidence"]
        if better:
            found[(*subject, attribute, canon)] = fact

    default = {"agent": ("agent", "agent:self"), "organization": ("organization", "organization:unknown")}.get(domain, ("user", "user:self"))
    for sentence in _SENTENCE.split(" ".join((content or "").split())):
        sentence = sentence.strip()
        bare = sentence.rstrip("。！？；;!?. ")
        if not bare:
            continue
        speaker, said = None, _SAID.match(bare)
        if said and (_NAME.match(said["who"] + " x") or re.fullmatch(r"[一-鿿]{2,4}", said["who"].strip())):
            if said["who"].split()[0] not in _NOT_NAMES and not said["who"].startswith("我"):
                speaker, bare = _named(said["who"].strip()), said["what"].strip(_EDGES)
                carried = speaker
        if sentence.endswith(("?", "？")):
            continue
        last = None
        for clause in {c.strip(" :：").lower(): c.strip(" :：") for c in _CLAUSE.split(bare)}.values():
            while (cut := _NOISE.sub("", clause)) != clause:
                clause = cut
            if _SUPPOSED.match(clause):
                break  # what follows in the sentence is supposed too
            if not clause or _QUESTION.match(clause) or _GUESS.search(clause) or _FUTURE.search(clause):
                last = None
                continue
            own = _explicit(clause, domain, agent_id)
            if speaker and (own is None or own[1] == "user:self"):
                own = speaker
            subject = own or carried or default
            carried = own or carried
            plain = re.sub(rf"^(?:he|she|they|it)?\s*{_ADVERB}\s+", "", clause, flags=re.I)
            hits = []
            for attribute, moves, patterns in _compiled():
                if attribute == "residence" and hits and hits[-1] == "schedule":
                    continue
                if attribute == "status" and "employment" in hits:
                    continue
                points = ATTRIBUTES[attribute][0]
                move = next((m for p in moves if (m := p.search(clause))), None)
                if move:
                    add(subject, attribute, move["a"], "historical", points - 5)
                    add(subject, attribute, move["b"], "update", points)
                    hits.append(attribute)
                    continue
                m = next((m for p in patterns if (m := p.search(plain)) or (m := p.search(clause))), None)
                if not m:
                    continue
                value = re.sub(r"^(?:私は|我|现在)", "", m["v"])
                change = change_of(clause, attribute)
                parts = re.split(r"\s*[、和]\s*|\s+or\s+", value) if attribute in LISTS else [value]
                for n, part in enumerate(parts):
                    add(subject, attribute, part, change, points - 5 * bool(n))
                hits.append(attribute)
                last = (subject, attribute, change, points)
            if not hits and last and last[1] in LISTS and len(clause.split()) <= 3 and own is None:
                add(last[0], last[1], clause, last[2], last[3] - 5)
    return list(found.values())


def detect_facts(units: DataFrame) -> DataFrame:
    """Add ``facts`` (array of structs) to units with content, domain and agent_id."""

    @F.pandas_udf(f"array<{FACT}>")
    def rules(content: pd.Series, domain: pd.Series, agent: pd.Series) -> pd.Series:
        return pd.Series([detect(c, d or "user", a) for c, d, a in zip(content, domain, agent)])

    return units.withColumn("facts", rules("content", "domain", "agent_id"))


PRIORITY = {"update": 6, "historical": 5, "negation": 5, "contradiction": 4, "addition": 3, "reaffirm": 2}


def best_fact(facts: Column) -> Column:
    """The fact of the strongest change, then of the highest confidence."""
    rank = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    scored = F.transform(facts, lambda f: F.struct(rank[f["change_type"]].alias("p"), f["confidence"].alias("c"), f.alias("f")))
    return F.array_max(scored)["f"]


def hydrate(units: DataFrame, extracted: str) -> DataFrame:
    """``facts``: those a model extracted, else those of the rules; the first of each subject,
    key, attribute, canonical value (else value) and change. Level-1 factual units alone, where
    the units tell their level and type, have facts."""
    rows = detect_facts(units)
    chosen = F.when(F.size(extracted) > 0, F.col(extracted)).otherwise(F.col("facts"))
    for name, value in (("level", 1), ("memory_type", "factual")):
        if name in units.columns:
            chosen = F.when(F.col(name) == value, chosen).otherwise(F.array().cast(f"array<{FACT}>"))

    def key(f: Column) -> Column:
        said = F.coalesce(f["canonical_value"], f["value"])
        return F.struct(f["subject"], f["subject_key"], f["attribute"], said, f["change_type"])

    def once(facts: Column) -> Column:
        keys = F.transform(facts, key)
        return F.filter(facts, lambda f, i: F.array_position(keys, key(f)) == i + 1)

    return rows.withColumn("facts", F.get(F.transform(F.array(chosen), once), 0))


STORED = (
    "struct<subject:string,subject_ref:string,subject_name:string,attribute:string,value:string,canonical_value:string,"
    "change_type:string,temporal_status:string,polarity:string,evidence_span:string,confidence:double>"
)


def stored(facts: Column) -> Column:
    """Facts as they are stored: what a change says of time and sign is told, confidence is a share."""

    def one(f: Column) -> Column:
        change = f["change_type"]
        when = F.when(change == "historical", "historical").when(change == "negation", "negated").otherwise("current")
        sign = F.when(change.isin("negation", "contradiction"), "negative").otherwise("positive")
        none = F.lit(None).cast("string")
        return F.struct(
            f["subject"].alias("subject"), f["subject_key"].alias("subject_ref"), none.alias("subject_name"), f["attribute"].alias("attribute"), f["value"].alias("value"),
            f["canonical_value"].alias("canonical_value"), change.alias("change_type"), when.alias("temporal_status"), sign.alias("polarity"), none.alias("evidence_span"),
            (f["confidence"] / 100).alias("confidence"),
        )

    return F.transform(facts, one)


def described(rows: DataFrame, col: str, out: str = "facts") -> DataFrame:
    """Add ``out``: facts of ``col`` (stored ones, or a model's of the same fields). Labels may be
    synonyms and the change is told by sign, time and name in this order; a fact whose subject or
    attribute has no label, or without a value, goes. A subject that isn't named is the unit's
    user or an unknown one."""
    from .correction import ATTRIBUTES as ATTRIBUTE_WORDS
    from .correction import SUBJECTS, parsed, resolve_change

    @F.pandas_udf("array<struct<canonical:string,kind:string>>")
    def canon(facts: pd.Series) -> pd.Series:
        out = []
        for each in facts:
            found = [(f["known"] or canonical(f["attribute"], f["value"])) if f["attribute"] and f["value"] else None for f in (each if each is not None else ())]
            out.append([{"canonical": c, "kind": value_kind(f["attribute"], c) if c else None} for f, c in zip(each if each is not None else (), found)])
        return pd.Series(out)

    def labelled(f: Column) -> Column:
        value = F.trim(F.regexp_replace(f["value"], r"\s+", " "))
        return F.struct(parsed(f["attribute"], ATTRIBUTE_WORDS).alias("attribute"), value.alias("value"), f["canonical_value"].alias("known"))

    def fact(f: Column, said: Column, c: Column) -> Column:
        subject, attribute = parsed(f["subject"], SUBJECTS), said["attribute"]
        own = F.when(subject == "user", "user:self").otherwise(F.concat(subject, F.lit(":unknown")))
        named = F.concat(subject, F.lit(":"), F.regexp_replace(F.lower(f["subject_name"]), r"[^\p{L}\p{N}]+", "_"))
        key = F.coalesce(f["subject_ref"], F.when(F.trim(f["subject_name"]) != "", named), own)
        change = resolve_change(f["polarity"], f["temporal_status"], f["change_type"], attribute)
        points = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), f["confidence"])) * 100).cast("int")
        return F.struct(
            subject.alias("subject"), key.alias("subject_key"), attribute.alias("attribute"), said["value"].alias("value"), c["canonical"].alias("canonical_value"),
            c["kind"].alias("value_kind"), change.alias("change_type"), points.alias("confidence"),
        )

    said = F.transform(col, labelled)
    parts = F.arrays_zip(F.col(col).alias("f"), said.alias("said"), canon(said).alias("c"))
    facts = F.transform(parts, lambda x: fact(x["f"], x["said"], x["c"]))
    whole = F.filter(facts, lambda f: f["subject"].isNotNull() & f["attribute"].isNotNull() & (f["value"] != ""))
    return rows.withColumn(out, F.coalesce(whole, F.array().cast(f"array<{FACT}>")))


EXPECTED = "array<struct<attribute:string,value:string,subject_key:string,change_type:string>>"


def evaluate(cases: DataFrame) -> DataFrame:
    """What the rules make of cases with known facts (``case``, ``language``, ``content``,
    ``expected``): a row a fact, expected or found. ``kind`` is ``expected`` or ``unexpected`` (a
    false positive); ``covered``: some fact has the value; ``attribute_ok``, ``subject_ok``,
    ``change_ok``: that one agrees in it; ``exact``: in all. A false negative is not covered."""
    rows = detect_facts(cases.withColumns({"domain": F.lit("user"), "agent_id": F.lit(None).cast("string")}))
    same = lambda a, b: F.lower(a["value"]) == F.lower(b["value"])

    def judged(e: Column) -> Column:
        alike = F.filter("facts", lambda f: same(f, e))
        # of several facts with the value the one that agrees most
        score = lambda f: (f["attribute"] == e["attribute"]).cast("int") * 4 + (f["subject_key"] == e["subject_key"]).cast("int") * 2 + (f["change_type"] == e["change_type"]).cast("int")
        best = F.coalesce(F.array_max(F.transform(alike, score)), F.lit(-1))
        return F.struct(
            F.lit("expected").alias("kind"), e["attribute"].alias("attribute"), e["change_type"].alias("change_type"), (best >= 0).alias("covered"),
            (best >= 4).alias("attribute_ok"), ((best >= 0) & (F.floor(best / 2) % 2 == 1)).alias("subject_ok"), ((best >= 0) & (best % 2 == 1)).alias("change_ok"), (best == 7).alias("exact"),
        )

    def extra(f: Column) -> Column:
        no = F.lit(False)
        return F.struct(
            F.lit("unexpected").alias("kind"), f["attribute"].alias("attribute"), f["change_type"].alias("change_type"), no.alias("covered"),
            no.alias("attribute_ok"), no.alias("subject_ok"), no.alias("change_ok"), no.alias("exact"),
        )

    more = F.filter("facts", lambda f: ~F.exists("expected", lambda e: same(f, e)))
    both = F.concat(F.transform("expected", judged), F.transform(more, extra))
    return rows.select("case", "language", F.explode(both).alias("x")).select("case", "language", "x.*")
