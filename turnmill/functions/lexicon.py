"""Lexical classifiers of commitments, decisions, actions and questions.

Each pattern is a fixed value that both Java and RE2 read; ``W`` stands for white
space.  The classifiers are compositions of native matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import S as W
from turnmill.functions.text import ascii_edges, clauses, js_trim

# Verbs of concrete actions.
VERBS_ZH = "负责|完成|跟进|处理|交付|执行|推进|承担|上线|发布|批准|提交|发送|修复|实现|部署|验证|通知|准备|整理|更新|迁移|申请|采购|签署|支付|联系|预约|召开|输出|同步|汇报"
VERBS_EN = rf"responsible|complete|deliver|execute|ship|launch|publish|approve|submit|send|fix|implement|deploy|verify|notify|prepare|update|migrate|contact|schedule|report|follow{W}*up"
_DO_EN = rf"complete|deliver|execute|ship|launch|publish|approve|submit|send|fix|implement|deploy|verify|notify|prepare|update|migrate|contact|schedule|report|follow{W}*up"
_IN_CLAUSE = r"[^，。；;,.!?！？\n]"

# The patterns.  (Where one to 24 characters of a clause may stand first, one is asked for: it is the same test, and linear.)
CONCRETE_ACTION = rf"(?i)安排|指定|{VERBS_ZH}|\b(?:assign(?:ed)?|{VERBS_EN}|will|must|shall)\b"
NEGATED_ACTION = (
    rf"(?i)(?:不|未|没有|并未|尚未|还未|无需|不再|拒绝|取消){W}*(?:会|将|再|继续|去|来|由{_IN_CLAUSE}{{0,20}})?{W}*(?:{VERBS_ZH}|安排|指定)|(?:{VERBS_ZH}|安排|指定){W}*(?:不了|不成|失败)"
    rf"|\b(?:not|never|won't|will{W}+not|would{W}+not|isn't|is{W}+not|aren't|are{W}+not|didn't|did{W}+not|doesn't|does{W}+not|don't|do{W}+not|hasn't|has{W}+not|haven't|have{W}+not|cannot|can't|cancel(?:led)?)\b.{{0,40}}\b(?:{VERBS_EN})\b"
)
REJECTED_ACTION = rf"(?:否决|驳回)了?{_IN_CLAUSE}{{0,40}}(?:{VERBS_ZH})"
DECISION = (
    rf"(?i)决定|确认|同意|通过|批准|否决|安排|定于|采用|选择|必须|不得|取消|延期|(?:由|让|请|安排|指定){W}*{_IN_CLAUSE}{{1,40}}?(?:负责|完成|跟进|处理|交付|执行|推进|承担|上线|发布)"
    rf"|{_IN_CLAUSE}{W}*(?:负责|将|承诺){W}*(?:完成|跟进|处理|交付|执行|推进|承担|上线|发布)"
    r"|\b(?:decid(?:e|ed)|agree(?:d)?|approv(?:e|ed)|reject(?:ed)?|will|must|shall|assign(?:ed)?|cancel(?:led)?|postpone(?:d)?)\b"
)
COMMITTED = (
    rf"(?i)(?:由|让|请|安排|指定){W}*{_IN_CLAUSE}{{1,40}}?(?:负责|完成|跟进|处理|交付|执行|推进|承担|上线|发布|批准|提交|发送|修复|实现|部署|验证|通知|准备|整理|更新|迁移)|{_IN_CLAUSE}{W}*(?:负责|将|会|承诺|必须){W}*(?:完成|跟进|处理|交付|执行|推进|承担|上线|发布|批准|提交|发送|修复|实现|部署|验证|通知|准备|整理|更新|迁移)"
    rf"|\b(?:assign(?:ed)?|will|must|shall|commit(?:s|ted)?{W}+to)\b.{{0,80}}\b(?:{_DO_EN})\b"
)
UNCERTAIN_ACTION = (
    r"(?i)如果|假如|若(?:是|果)?|是否|能否|可否|可能|也许|或许|不一定|待定|尚未确定|预计|预期|计划|打算|考虑|未承诺|尚未承诺"
    rf"|\b(?:if|whether|maybe|perhaps|might|could|possibly|probably|plan(?:s|ned)?{W}+to|expect(?:s|ed)?{W}+to|intend(?:s|ed)?{W}+to|not{W}+committed|uncommitted)\b"
)
NOT_MADE = (
    rf"(?i)(?:没有|并没有|还没有|还没|尚未|暂未|并未|未能|尚无|暂无){W}*(?:最终{W}*)?(?:(?:作出|做出|形成|达成){W}*)?(?:决定|决策|确认|承诺|敲定|同意|批准|通过|安排|指定)|未{W}*(?:最终{W}*)?(?:作出|做出|形成|达成){W}*(?:决定|决策|确认|承诺|敲定|同意|批准|通过|安排|指定)"
    rf"|(?:没有人|没人|无人){W}*(?:决定|确认|承诺|同意|批准|安排|指定)|(?:不|未){W}*(?:决定|确认|承诺|敲定)"
    rf"|(?:还|仍|尚)?{W}*(?:需要|需){W}*(?:(?:就|对|针对){_IN_CLAUSE}{{0,40}}(?:作出|做出|形成|达成){W}*|(?:作出|做出|形成|达成){W}*)?(?:决定|决策|确认|承诺|敲定|同意|批准|通过|安排|指定)"
    rf"|(?:最终{W}*)?(?:决定|决策|确认|承诺|同意|批准|通过|安排|指定){W}*(?:仍|还|尚|暂)?{W}*(?:未|没有|并未){W}*(?:最终{W}*)?(?:作出|做出|形成|达成|完成|明确|敲定)"
    rf"|\b(?:(?:(?:did|do|does|has|have|had|is|are|was|were){W}+not|(?:didn't|doesn't|don't|hasn't|haven't|hadn't|isn't|aren't|wasn't|weren't)){W}+(?:yet{W}+)?(?:been{W}+)?(?:decid(?:e|ed)|confirm(?:ed)?|commit(?:ted)?|agree(?:d)?|approv(?:e|ed)|assign(?:ed)?)"
    rf"|not{W}+(?:yet{W}+)?(?:decided|confirmed|committed|agreed|approved|assigned)|no{W}+(?:final{W}+)?(?:decision|confirmation|commitment|agreement|approval|assignment)"
    rf"|(?:nobody|no{W}+one).{{0,40}}\b(?:decid(?:e|ed)|confirm(?:ed)?|commit(?:ted)?|agree(?:d)?|approv(?:e|ed)|assign(?:ed)?|will)|never{W}+(?:decid(?:e|ed)|confirm(?:ed)?|commit(?:ted)?|agree(?:d)?|approv(?:e|ed)|assign(?:ed)?)"
    rf"|(?:have|has|had){W}+yet{W}+to{W}+(?:decide|confirm|commit|agree|approve|assign)|(?:fail(?:s|ed)?{W}+to|(?:still{W}+)?need(?:s|ed)?{W}+to){W}+(?:decide|confirm|commit|agree|approve|assign)|(?:must|should){W}+decide"
    rf"|(?:decision|confirmation|commitment|agreement|approval|assignment){W}+(?:is|remains?){W}+(?:pending|unresolved)|remains?{W}+(?:undecided|unconfirmed|uncommitted))\b"
)
UNRESOLVED = (
    rf"(?i)是否|能否|可否|要不要|该不该|还(?:需要|需)讨论|仍(?:需要|需)讨论|(?:没有|并没有|并未|还没|还未|尚未|暂未|未能|未曾|从未|尚无|暂无){W}*(?:(?:作出|做出)?{W}*(?:决定|确认|敲定|批准|同意|通过|采用|选择)|承诺)|尚(?:未|待)|未(?:决定|确认|敲定|承诺)|待(?:讨论|确认|决定|评估)|有待"
    rf"|可能|也许|或许|不确定|如果|假如|若(?:是|果)?|听说|据说|传闻|(?:预计|预期|计划|打算|考虑|倾向于){W}*(?:将|会|要|采用|选择|上线|发布|提交|部署|执行|完成)"
    rf"|\b(?:if|unless|whether|maybe|might|may|could|should we|reportedly|heard|rumou?r|(?:did|does|do|has|have|had|was|were|is|are){W}+not{W}+(?:yet{W}+)?(?:decide(?:d)?|confirm(?:ed)?|commit(?:ted)?)"
    rf"|(?:didn't|doesn't|don't|hasn't|haven't|hadn't|wasn't|weren't|isn't|aren't){W}+(?:yet{W}+)?(?:decide(?:d)?|confirm(?:ed)?|commit(?:ted)?)|not{W}+(?:yet{W}+)?(?:decided|confirmed|committed)"
    rf"|to be (?:discussed|decided|confirmed)|pending (?:discussion|decision|confirmation)|plan(?:s|ned)?{W}+to|expect(?:s|ed)?{W}+to|intend(?:s|ed)?{W}+to)\b"
)
QUESTION_END = rf"[?？]{W}*$|(?:吗|嘛|呢|对吗|对不对)[。.!！]*$"
QUESTION_IS = rf"(?i)\b(?:the{W}+)?(?:open{W}+)?question{W}+(?:is|was|remains?){W}+(?:who|when|which|what|where|whether|why|how)\b"
ANSWERED = (
    rf"(?i)(?:答案|结论){W}*(?:是|为)|(?:已|已经|最终|现已){W}*(?:确认|确定|明确|敲定)(?:{W}*(?:由|为)|{_IN_CLAUSE}{{0,80}}(?:谁|哪位|哪个人|何人|何时|什么时候|哪天|几号){_IN_CLAUSE}{{0,80}}(?:[:：]|(?:是|为|由)))"
    rf"|\b(?:decid(?:e|ed)|confirm(?:ed)?|determin(?:e|ed)|clarif(?:y|ied))\b.{{0,80}}\b(?:who|when|which|what|where|whether|why|how)\b.{{0,80}}(?::|\b(?:is|was|will{W}+be)\b)"
)
GENERIC_POLICY = rf"(?:无论|不论|不管){W}*(?:谁|哪位|哪个人|何人).{{0,80}}都"
WH_ZH = "谁|哪位|哪个人|何人|何时|什么时候|哪天|几号|什么|哪个|哪种"
CHOICE_ZH = "是否|能否|可否|要不要|该不该|是不是"
OPEN_EN = rf"(?i)\b(?:discuss(?:ed|es|ing)?|debate(?:d|s|ing)?|wonder(?:ed|s|ing)?|ask(?:ed|s|ing)?|remain(?:s|ed)?{W}+(?:unclear|unknown|unresolved)|(?:is|are|was|were){W}+(?:unclear|unknown|unresolved))\b.{{0,80}}\b(?:who|when|which|what|where|whether|why|how)\b"
INVERTED_EN = (
    rf"(?i)^{W}*(?:(?:so|then|okay|well){W}+)?(?:who|when|which|what|where|why|how)\b{W}+(?:will|would|can|could|should|is|are|do|does|did|has|have)\b"
    rf"|^{W}*(?:(?:so|then|okay|well){W}+)?(?:will|would|can|could|should|is|are|do|does|did|has|have)\b{W}+[^\t\n\x0B\f\r \x{{a0}}\x{{3000}},.!?]+{W}+"
)
DUE = (
    rf"(?i)今天|明天|后天|本周|下周|周[一二三四五六日天]|星期[一二三四五六日天]|月底|月末|年底|年末|[0-9]{{1,4}}{W}*(?:年|[-/.]){W}*[0-9]{{1,2}}|[0-9]{{1,2}}{W}*(?:月|[-/.]){W}*[0-9]{{1,2}}|[0-9]{{1,2}}{W}*(?:点|时|:){W}*[0-9]{{0,2}}"
    rf"|\b(?:today|tomorrow|tonight|eod|eow|cob|monday|tuesday|wednesday|thursday|friday|saturday|sunday|next{W}+(?:week|month|quarter|year))\b"
)
UNSAFE_QUALIFIER = (
    rf"(?i)如果|若|假如|假设|除非|一旦|倘若|前提是|可能|也许|或许|未必|不一定|是否|能否|可否|要不要|听说|据说|传闻|似乎|好像|看起来|[吗呢么嘛吧]{W}*$"
    r"|\b(?:if|unless|once|when|whenever|provided|assuming|in case|as long as|whether|should|would|may|maybe|might|could|likely|possibly|perhaps|apparently|seemingly|reportedly|allegedly)\b"
)


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(ascii_edges(pattern))


def explicit_decision(text: Column) -> Column:
    """F1."""
    return _has(text, DECISION)


def concrete_action(text: Column) -> Column:
    """F4."""
    return _has(text, CONCRETE_ACTION)


def direct_question(value: Column) -> Column:
    """F6."""
    text = js_trim(value)
    open_ = _has(text, CHOICE_ZH) | _has(text, OPEN_EN)
    asks = _has(text, WH_ZH) & F.exists(clauses(text), lambda c: _has(c, WH_ZH) & (_has(c, CONCRETE_ACTION) | _has(c, DECISION)))  # the first test spares most texts their clauses
    predicate = _has(text, CONCRETE_ACTION) | _has(text, DECISION)
    settled = _has(text, ANSWERED) | _has(text, GENERIC_POLICY)
    return F.when(text == "", False).otherwise(
        _has(text, QUESTION_END) | _has(text, QUESTION_IS) | (predicate & ((~settled & (asks | open_)) | _has(text, INVERTED_EN)))
    )


def not_made(text: Column) -> Column:
    """F7."""
    return _has(text, NOT_MADE)


def uncertain_decision(text: Column) -> Column:
    """F2."""
    return text.rlike("[?？]") | direct_question(text) | not_made(text) | _has(text, UNRESOLVED)


def decision(text: Column) -> Column:
    """F3."""
    return explicit_decision(text) & ~uncertain_decision(text)


def uncertain_action(text: Column) -> Column:
    """F5."""
    return text.rlike("[?？]") | direct_question(text) | not_made(text) | _has(text, UNCERTAIN_ACTION) | _has(text, NEGATED_ACTION) | _has(text, REJECTED_ACTION)


def committed_action(text: Column) -> Column:
    """F8."""
    return explicit_decision(text) | _has(text, COMMITTED)


def affirmative_action(text: Column) -> Column:
    """F9."""
    return concrete_action(text) & committed_action(text) & ~uncertain_decision(text) & ~uncertain_action(text)


def defensive_floor(text: Column) -> Column:
    """a commitment may stand unless the text asks or denies it."""
    return (js_trim(text) != "") & ~text.rlike("[?？]") & ~direct_question(text) & ~not_made(text)


def plausible_due(text: Column) -> Column:
    """F11."""
    return _has(text, DUE)


def classify(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every classifier of a text, each pattern matched once."""
    t = F.col("t_")
    base = df.select(F.col(key), F.col(text).alias("t_")).select(
        key, (js_trim(t) != "").alias("some_"), _has(t, DECISION).alias("decision_words"), _has(t, CONCRETE_ACTION).alias("action_words"), direct_question(t).alias("question"), not_made(t).alias("not_made"),
        _has(t, "[?？]").alias("mark_"), _has(t, UNRESOLVED).alias("open_"), (_has(t, UNCERTAIN_ACTION) | _has(t, NEGATED_ACTION) | _has(t, REJECTED_ACTION)).alias("weak_"), _has(t, COMMITTED).alias("bound_"),
        _has(t, DUE).alias("due"), _has(t, UNSAFE_QUALIFIER).alias("qualified"),
    )
    c = F.col
    doubt = c("mark_") | c("question") | c("not_made")
    unresolved, uncertain, committed = doubt | c("open_"), doubt | c("weak_"), c("decision_words") | c("bound_")
    return base.select(
        key, "decision_words", unresolved.alias("unresolved"), "action_words", uncertain.alias("uncertain_action"), "question", "not_made", committed.alias("committed"), (c("decision_words") & ~unresolved).alias("decision"),
        (c("action_words") & committed & ~unresolved & ~uncertain).alias("affirmative"), (c("some_") & ~doubt).alias("floor_passed"), "due", "qualified",
    )
