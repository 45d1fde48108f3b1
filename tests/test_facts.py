"""Facts from statements: value, attribute, subject and change type. All sentences are our own."""

import pytest

from mnemospark.operators import facts

SELF, MARA, TIDE, NOBODY = "user:self", "external:mara_lind", "organization:tidewater_studio", "external:unknown"


def said(*found, of=SELF):
    return [(attribute, value, of, change) for attribute, value, change in found]


CASES = {
    # one fact, several languages
    "I now live in Tromsø": said(("residence", "Tromsø", "update")),
    "我现在住在昆明": said(("residence", "昆明", "update")),
    "我不喜欢芹菜": said(("preference", "芹菜", "contradiction")),
    "我的邮箱是 mara@post.example": said(("contact", "mara@post.example", "reaffirm")),
    "Vivo en Sevilla": said(("residence", "Sevilla", "reaffirm")),
    "Mi correo es mara@post.example": said(("contact", "mara@post.example", "reaffirm")),
    "Trabajo en Faro": said(("employment", "Faro", "reaffirm")),
    "私は札幌に住んでいます": said(("residence", "札幌", "reaffirm")),
    "私は蕎麦が好きです": said(("preference", "蕎麦", "reaffirm")),
    "I work as a bookbinder": said(("status", "bookbinder", "reaffirm")),
    "I also speak Finnish": said(("skill", "Finnish", "addition")),
    "联系我：mara@post.example": said(("contact", "mara@post.example", "reaffirm")),
    "My phone number is +47 22 33 44 55": said(("contact", "+47 22 33 44 55", "reaffirm")),
    "I own a rowing boat": said(("ownership", "rowing boat", "reaffirm")),
    # lists
    "我擅长木工和剪纸": said(("skill", "木工", "reaffirm"), ("skill", "剪纸", "reaffirm")),
    "I like rowing and chess": said(("preference", "rowing", "reaffirm"), ("preference", "chess", "reaffirm")),
    # change types
    "I used to work at Kelp Bakery": said(("employment", "Kelp Bakery", "historical")),
    "我不再在蓝塔工作": said(("employment", "蓝塔", "negation")),
    "I used to work at Kelp Bakery, now work at Ferrymen": said(("employment", "Kelp Bakery", "historical"), ("employment", "Ferrymen", "update")),
    "我之前住在西安，现在住在昆明": said(("residence", "西安", "historical"), ("residence", "昆明", "update")),
    "Actually, I no longer work at Ferrymen. I also speak Finnish. I also love sailing.": said(("employment", "Ferrymen", "negation"), ("skill", "Finnish", "addition"), ("preference", "sailing", "addition")),
    "I live in Lund. Actually, scratch that, I now live in Tromsø.": said(("residence", "Lund", "reaffirm"), ("residence", "Tromsø", "update")),
    "我住在西安。不是，我现在住在昆明。": said(("residence", "西安", "reaffirm"), ("residence", "昆明", "update")),
    "I sold my rowing boat": said(("ownership", "rowing boat", "negation")),
    "I work at Ferrymen also speak Finnish": said(("employment", "Ferrymen", "reaffirm"), ("skill", "Finnish", "addition")),
    "我住在昆明另外会说芬兰语": said(("residence", "昆明", "reaffirm"), ("skill", "芬兰语", "addition")),
    "I currently live in Lund": said(("residence", "Lund", "update")),
    "Antes trabajaba mucho, ahora vivo en Sevilla": said(("residence", "Sevilla", "update")),
    # from an old value to a new one
    "My email changed from m1@post.example to m2@post.example": said(("contact", "m1@post.example", "historical"), ("contact", "m2@post.example", "update")),
    "我的邮箱从 m1@post.example 改成 m2@post.example": said(("contact", "m1@post.example", "historical"), ("contact", "m2@post.example", "update")),
    "I moved from Lund to Tromsø and changed my phone from 555 0199 888 to 555 0123 777": said(("residence", "Lund", "historical"), ("residence", "Tromsø", "update"), ("contact", "555 0199 888", "historical"), ("contact", "555 0123 777", "update")),
    "我从西安搬到昆明，并且把邮箱从 m1@post.example 改成 m2@post.example": said(("residence", "西安", "historical"), ("residence", "昆明", "update"), ("contact", "m1@post.example", "historical"), ("contact", "m2@post.example", "update")),
    "I left Ferrymen to join Kelp Bakery": said(("employment", "Ferrymen", "historical"), ("employment", "Kelp Bakery", "update")),
    # several sentences
    "I now live in Tromsø and my email is mara@post.example": said(("residence", "Tromsø", "update"), ("contact", "mara@post.example", "reaffirm")),
    "I live in Lund; my email is mara@post.example; I work at Ferrymen": said(("residence", "Lund", "reaffirm"), ("contact", "mara@post.example", "reaffirm"), ("employment", "Ferrymen", "reaffirm")),
    "私は札幌に住んでいます。メールは mara@post.example です。私は青樹で働いています。": said(("residence", "札幌", "reaffirm"), ("contact", "mara@post.example", "reaffirm"), ("employment", "青樹", "reaffirm")),
    "J'habite à Nantes. Mon email est mara@post.example. Je travaille chez Lutin. Je suis relieuse.": said(("residence", "Nantes", "reaffirm"), ("contact", "mara@post.example", "reaffirm"), ("employment", "Lutin", "reaffirm"), ("status", "relieuse", "reaffirm")),
    "Ich wohne in Jena. Meine E-Mail ist mara@post.example. Ich arbeite bei Kranich. Ich bin Tischlerin.": said(("residence", "Jena", "reaffirm"), ("contact", "mara@post.example", "reaffirm"), ("employment", "Kranich", "reaffirm"), ("status", "Tischlerin", "reaffirm")),
    "Moro em Braga. Meu email é mara@post.example. Trabalho na Garça. Sou padeira.": said(("residence", "Braga", "reaffirm"), ("contact", "mara@post.example", "reaffirm"), ("employment", "Garça", "reaffirm"), ("status", "padeira", "reaffirm")),
    # whom a statement is about
    "赵敏住在西安": said(("residence", "西安", "reaffirm"), of="external:赵敏"),
    "蓝鲸公司位于厦门": said(("residence", "厦门", "reaffirm"), of="organization:蓝鲸公司"),
    "赵敏丈夫是孙亮": said(("relationship", "孙亮", "reaffirm"), of="external:赵敏"),
    "Inés Duarte vive en Sevilla y trabaja en Faro": said(("residence", "Sevilla", "reaffirm"), ("employment", "Faro", "reaffirm"), of="external:inés_duarte"),
    "Mara Lind is married to Otto Brandt": said(("relationship", "Otto Brandt", "reaffirm"), of=MARA),
    "Tidewater Studio is based in Jena": said(("residence", "Jena", "reaffirm"), of=TIDE),
    "Mara Lind lives in Lund, works at Ferrymen, and likes rowing": said(("residence", "Lund", "reaffirm"), ("employment", "Ferrymen", "reaffirm"), ("preference", "rowing", "reaffirm"), of=MARA),
    "btw, Mara Lind lives in Lund. now works at Ferrymen. also likes rowing haha": said(("residence", "Lund", "reaffirm"), ("employment", "Ferrymen", "update"), ("preference", "rowing", "addition"), of=MARA),
    "I live in Lund. Mara Lind works at Ferrymen. Tidewater Studio is based in Jena. I also speak Finnish.": said(("residence", "Lund", "reaffirm"), ("skill", "Finnish", "addition")) + said(("employment", "Ferrymen", "reaffirm"), of=MARA) + said(("residence", "Jena", "reaffirm"), of=TIDE),
    "Mara Lind said he works at Ferrymen and likes rowing": said(("employment", "Ferrymen", "reaffirm"), ("preference", "rowing", "reaffirm"), of=MARA),
    'Mara Lind said "I now live in Tromsø"': said(("residence", "Tromsø", "update"), of=MARA),
    "赵敏说“我现在住在昆明，并且在蓝塔工作”": said(("residence", "昆明", "update"), ("employment", "蓝塔", "reaffirm"), of="external:赵敏"),
    # appointments
    "面试改到后天上午十点": said(("schedule", "后天上午十点", "update"), of=NOBODY),
    "会议定于周五上午九点": said(("schedule", "周五上午九点", "reaffirm"), of=NOBODY),
    "The interview is at 9am on Friday": said(("schedule", "9am on Friday", "reaffirm"), of=NOBODY),
    "um, the meeting is at about 11am tmrw haha": said(("schedule", "about 11am tmrw", "reaffirm"), of=NOBODY),
    "Could you tell me where I used to live? by the way, quick update: I now live in Tromsø, and my email changed from m1@post.example to m2@post.example. also, the meeting is at about 11am tmrw haha":
        said(("residence", "Tromsø", "update"), ("contact", "m1@post.example", "historical"), ("contact", "m2@post.example", "update")) + said(("schedule", "about 11am tmrw", "reaffirm"), of=NOBODY),
}
NOTHING = [
    "Did I tell you where I live?", "Could you say what my phone is?", "Perhaps I'll settle in Braga some day", "我也许搬去厦门", "I'll join Ferrymen in spring",
    "They plan to move to Jena", "我下周会搬去厦门", "我打算去厦门发展", "If I move to Braga, send a card", "Imagine Otto lives in Nantes",
    "For instance, I work at Ferrymen", "假如我搬去厦门", "比如我住在西安", "咱们将会搬到厦门", "", None, "the tide was low",
]


@pytest.mark.parametrize("content", CASES)
def test_detects(content):
    got = [(f["attribute"], f["value"], f["subject_key"], f["change_type"]) for f in facts.detect(content)]
    assert sorted(got) == sorted(CASES[content])


@pytest.mark.parametrize("content", NOTHING)
def test_not_asserted(content):
    assert facts.detect(content) == []


def test_agent_and_canonical_values():
    got = facts.detect("我是图书管理员", "agent", "helper-two")
    assert [(f["subject_key"], f["value"]) for f in got] == [("agent:helper_two", "图书管理员")]
    assert facts.detect("um, the meeting is at about 11am tmrw haha")[0]["canonical_value"] == "11am tomorrow"
    assert facts.detect("My phone number is +47 22 33 44 55")[0]["value_kind"] == "phone"


def test_spark_form(spark):
    rows = [(n, c, "user", None) for n, c in enumerate(CASES)] + [(-1, None, "user", None)]
    units = spark.createDataFrame(rows, "n int, content string, domain string, agent_id string")
    got = facts.detect_facts(units)
    best = {r.n: r.b for r in got.select("n", facts.best_fact(got["facts"]).alias("b")).collect()}
    assert best[-1] is None and best[0].value == "Tromsø"
    assert {r.n: len(r.facts) for r in got.collect() if r.n >= 0} == {n: len(e) for n, e in enumerate(CASES.values())}
