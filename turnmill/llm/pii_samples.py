"""Composed sentences with marked values, which the field of :mod:`turnmill.llm.pii` is trained on.

Values are invented: names from syllables, numbers from digits.  Look-alikes that
are no values (tickets, versions, addresses of networks, amounts, times, product
names, places) are among them, unmarked.
"""

from __future__ import annotations

import random

from turnmill.llm.quality import COMMON_CHINESE as COMMON
from turnmill.llm.quality import common_ideographs
from turnmill.llm.samples import ADJECTIVES, HAN_NOUNS, HAN_VERBS, NOUNS, VERBS, Maker

# Common Chinese family names.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符舒阮柯纪梅童凌毕单季裴霍涂成苗谷盛曲翁冉骆蓝路游辛靳管柴蒙鲍华喻祁蒲房滕屈饶解牟艾尤阳时穆农司卓古吉缪简车项连芦麦褚娄窦戚岑景党宫费卜冷晏席卫米柏宗瞿桂全佟应臧闵苟邬边卞姬师和仇栾隋商刁沙荣巫寇桑郎甄丛仲虞敖巩明佘池查麻苑迟邝"
COMPOUND_SURNAMES = frozenset("欧阳 上官 司马 诸葛 东方 皇甫 尉迟 公孙 慕容 令狐 司徒 长孙 宇文 夏侯 轩辕 端木 南宫 百里 闻人 独孤 西门 申屠 太史 公冶 濮阳 淳于 单于 澹台 钟离 呼延 东郭 微生 拓跋 司空 第五 梁丘 左丘 东门 南门 乐正".split())
GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰红建文志国海燕鑫波宁晓雪梅琳宇浩然子涵欣怡梓轩雨泽思远嘉俊熙诗琪若曦佳颖天一诺可心安然书瑶清扬望舒怀瑾知夏听澜星野归晚未眠景行云舒墨白青禾南乔北辰千寻如初长歌临渊念慈疏影朝颜霁月楚珩砚秋闻溪照晚其琛昭棠鹤鸣竹溪"
_IDEOGRAPHS = "".join(sorted(common_ideographs()))
_COMPOUND = sorted(COMPOUND_SURNAMES)
TITLES_HAN = ["", "", "", "", "同学", "老师", "总", "经理", "先生", "女士", "工", "主任"]
_ON = "b br c ch d dr f fr g gr h j k kl l m n p pr qu r s st sw t th tr v w wh y z".split()
_MID = "a e i o u ae ea ia ou ei".split()
_OFF = "l n r s th m ck nd rt lf ng d x ll".split()
_GIVEN_END = "a en in o us ia elle ric mund wen bert lin da na ette is ine or".split()
_FAMILY_END = "ton ford wick ham field worth ley brook wood stead combe gate croft shaw man son berg ster hurst yard low row cote mere bridge castle quist dale".split()
# Given names that are words or months as well.
_WORD_NAMES = "Mark Will May Grace Rose Bill Frank Hope Dawn Faith Ivy Jack Art Pat Ray Sue Drew Chase Hunter Olive June April Rob Bob Dale Glen Clay".split()
_STREET = "Street Road Avenue Lane Close Court Drive Place Square Terrace Crescent Gardens Grove Hill Way".split()


class Values:
    def __init__(self, r: random.Random):
        self.r = r

    def _syllable(self) -> str:
        r = self.r
        return r.choice(_ON) + r.choice(_MID) + (r.choice(_OFF) if r.random() < 0.6 else "")

    def given(self) -> str:
        if self.r.random() < 0.12:
            return self.r.choice(_WORD_NAMES)
        w = (self._syllable() + self.r.choice(_GIVEN_END)).capitalize()
        return w.replace("a", self.r.choice("áäâ"), 1) if self.r.random() < 0.08 else w.replace("e", self.r.choice("éëè"), 1) if self.r.random() < 0.1 else w

    def family(self) -> str:
        w = (self._syllable() + self.r.choice(_FAMILY_END)).capitalize()
        return ("O'" + w) if self.r.random() < 0.04 else w

    def name(self) -> str:
        r = self.r
        g, f = self.given(), self.family()
        return r.choice([f"{g} {f}", f"{g} {f}", f"{g} {f}", g, g, f, f, f"{r.choice(['Dr.', 'Mr.', 'Ms.', 'Mrs.', 'Prof.', 'Dr', 'Mr', 'Ms', 'Professor'])} {f}", f"{f}, {g}", f"{g[0]}. {f}", f"{g} {r.choice('ABCDEFGHJKLMNPRSTW')}. {f}"])

    def han_name(self) -> str:
        r = self.r
        s = r.choice(_COMPOUND) if r.random() < 0.2 else r.choice(SURNAMES)
        g = "".join(r.choice(GIVEN if r.random() < 0.75 else COMMON if r.random() < 0.5 else _IDEOGRAPHS) for _ in range(r.choice([1, 2, 2, 2])))
        t = r.choice(TITLES_HAN)
        if t in ("总", "工", "经理", "老师", "主任") and r.random() < 0.6:
            return s + t
        return r.choice([s + g, s + g, s + g + t, ("小" if r.random() < 0.5 else "老") + s if r.random() < 0.15 else s + g])

    def made_up(self) -> str:
        """A word that means nothing, with the ending of a common kind of word."""
        r = self.r
        return self._syllable() + (self._syllable() if r.random() < 0.5 else "") + r.choice(["", "", "ed", "ing", "er", "y", "ly", "al", "ous", "ent", "ate", "tion", "ment", "s", "able", "ic", "ive", "ful", "age", "ow", "ary"])

    def word(self) -> str:
        r = self.r
        return r.choice([r.choice("river maple cedar north old mill ferry tanner windmill juniper larkspur station church orchard copper beech bramble oak stone garden bridge high long".split()), self._syllable() + self._syllable()])

    def place(self) -> str:
        return " ".join((self._syllable() + self.r.choice("mouth fen ton ville bury hollow quill ford".split())).capitalize() for _ in range(self.r.choice([1, 1, 2])))

    def email(self) -> str:
        r = self.r
        user = r.choice([self._syllable() + self._syllable(), f"{self._syllable()}.{self._syllable()}", f"{self._syllable()}_{self._syllable()}", f"{self._syllable()}-{self._syllable()}", self._syllable() + "+" + self._syllable()])
        user += str(r.randrange(1, 99)) if r.random() < 0.4 else ""
        host = ".".join(r.choice([self._syllable(), "mail", "team", "example", "post"]) for _ in range(r.choice([1, 1, 2]))) + "." + r.choice(["com", "org", "net", "test", "cn", "io"])
        how = r.random()
        if how < 0.25:
            said = lambda s: s.replace("+", " plus ").replace("_", " underscore ").replace("-", "-").replace(".", " dot ")
            return f"{said(user)} at {said(host)}"
        if how < 0.33:
            return f"{user} @ {host}"
        if how < 0.4:
            return user.replace(".", "点").replace("+", "") + "艾特" + host.replace(".", "点")
        m = f"{user}@{host}"
        m = r.choice([m, m, m, m.upper(), m.title()])
        return f"<{m}>" if r.random() < 0.15 else m

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def phone(self, zh: bool) -> str:
        r = self.r
        if zh:
            a, b, c = "1" + r.choice("3456789") + self.digits(1), self.digits(4), self.digits(4)
            how = r.random()
            if how < 0.2:
                return "".join({"1": "幺"}.get(d, "零一二三四五六七八九"[int(d)]) if r.random() < 0.9 or d == "1" else "零一二三四五六七八九"[int(d)] for d in a + b + c)
            if how < 0.3:
                return r.choice([f"0{self.digits(2)}-{self.digits(8)}", f"(0{self.digits(3)}) {self.digits(8)}", f"(0{self.digits(2)}){self.digits(4)} {self.digits(4)}"])
            sep = r.choice(["", "", "-", " "])
            return r.choice(["", "", "+86 ", "+86", "86-"]) + sep.join([a, b, c])
        a, b, c = str(r.randrange(201, 989)), self.digits(3), self.digits(4)
        if r.random() < 0.25:
            w = "zero one two three four five six seven eight nine".split()
            return " ".join("oh" if d == "0" and r.random() < 0.2 else w[int(d)] for d in a + b + c)
        return r.choice([f"({a}) {b}-{c}", f"+1 {a} {b} {c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"+44 {self.digits(4)} {self.digits(6)}", f"0{self.digits(2)} {self.digits(4)} {self.digits(4)}", f"{a}{b}{c} ext. {self.digits(2)}", f"{a}{b}{c}", f"+1-{a}-{b}-{c}", f"+{r.randrange(30, 98)} {self.digits(2)} {self.digits(4)} {self.digits(4)}"])

    def national(self) -> str:
        r = self.r
        a = self.digits(6)
        d = f"{r.randrange(1950, 2010)}{r.randrange(1, 13):02d}{r.randrange(1, 29):02d}"
        c = self.digits(3) + r.choice("0123456789XXX")
        return r.choice([a + d + c, a + d + c, a + d + c, f"{a} {d} {c}", f"{a}-{d}-{c}"])

    def number(self, zh: bool) -> tuple[str, str]:
        """What it is called, and the number."""
        r = self.r
        if zh:
            if r.random() < 0.25:
                return r.choice(["护照号", "护照号码", "护照", "证件号"]), r.choice("EGPDH") + self.digits(8)
            return r.choice(["身份证", "身份证号", "身份证号码", "证件号码", "身份证尾号不对，完整的是", "证件"]), self.national()
        how = r.random()
        if how < 0.35:
            return r.choice(["social security number", "SSN", "social", "social security"]), r.choice(["-", " "]).join([self.digits(3), self.digits(2), self.digits(4)])
        if how < 0.65:
            return r.choice(["passport number", "passport", "passport no."]), r.choice(["X", "E", "G", "AB", "K"]) + self.digits(8)
        return r.choice(["national ID", "ID number", "identity number", "national ID number", "id card number"]), self.national()

    def address(self, zh: bool) -> str:
        r = self.r
        if zh:
            road = "".join(r.choice("松听白望长拾云清东西南北中山和平建设竹柳花石桥风月雨鹭湖溪穗间") for _ in range(2)) + r.choice("路路街巷") if r.random() < 0.9 else "".join(r.choice("东西南北中山和平") for _ in range(2)) + "大道"
            num = str(r.randrange(1, 400)) if r.random() < 0.9 else r.choice(["二十七", "一百零三", "八十", "三百一十二"])
            sp = " " if r.random() < 0.15 else ""
            tail = r.choice(["", "", f"{sp}{r.randrange(1, 20)}{sp}单元", f"{r.randrange(1, 20)}栋{r.randrange(101, 2001)}室", f"{r.randrange(2, 30)}楼"])
            city = "".join(r.choice("澄云望青海临安江岭川浦阳城屿平") for _ in range(2)) + "市"
            area = "".join(r.choice("鹿栖南湖东西城霞鸣江北") for _ in range(2)) + "区"
            return r.choice([city + area, city, area, "", city + area]) + f"{road}{sp}{num}{sp}号" + tail
        road = f"{' '.join(self.word() for _ in range(r.choice([1, 1, 2])))} {r.choice(_STREET)}"
        road = road.title() if r.random() < 0.6 else road.lower()
        a = f"{r.randrange(1, 400)}{r.choice(['', '', '', 'a', 'B'])} {road}"
        if r.random() < 0.15:
            a = f"{r.choice(['Flat', 'Unit', 'Apartment', 'Suite'])} {r.randrange(1, 60)}, {a}"
        return a + r.choice(["", "", f", {self.place()}", f" in {self.place()}"])

    def han_word(self) -> str:
        """Two or three ideographs that mean nothing; a family name's character may be any of them."""
        r = self.r
        one = lambda: r.choice(SURNAMES) if r.random() < 0.3 else r.choice(_IDEOGRAPHS if r.random() < 0.6 else COMMON)
        return "".join(one() for _ in range(r.choice([2, 2, 2, 3])))

    def han_noise(self) -> str:
        """Ideographs in a row that mean nothing."""
        return "".join(self.r.choice([self.han_word, lambda: self.r.choice(COMMON), lambda: self.r.choice(HAN_NOUNS)])() for _ in range(self.r.randrange(2, 9)))

    def about_person(self, zh: bool) -> str:
        """A template of what a person does, or of what is done with one, among words that mean nothing."""
        r = self.r
        if zh:
            tail = r.choice(["", "", "", "".join(r.choice(COMMON) for _ in range(r.randrange(1, 5)))])
            return r.choice([
                lambda: "{n}" + r.choice(_ZH_DOES) + tail, lambda: r.choice(_ZH_WITH) + "{n}" + r.choice(["", tail, r.choice(_ZH_DOES)]), lambda: r.choice(_ZH_WITH) + "{n}" + r.choice(_ZH_DOES) + tail,
                lambda: r.choice(HAN_NOUNS) + r.choice(_ZH_WITH) + "{n}" + r.choice(HAN_VERBS), lambda: "{n}" + r.choice(HAN_VERBS) + "了" + r.choice(HAN_NOUNS), lambda: "{n}", lambda: "{n}、{n}" + r.choice(_ZH_DOES),
            ])()
        return r.choice([
            lambda: "{n} " + r.choice(_EN_DOES), lambda: r.choice(_EN_WITH) + " {n}", lambda: r.choice(_EN_WITH) + " {n} " + r.choice(_EN_DOES), lambda: r.choice(_EN_WITH) + " {n} " + self.made_up(),
            lambda: f"{self.made_up()} {r.choice(_EN_WITH)} {{n}} {self.made_up()}", lambda: "{n} " + self.made_up() + " the " + self.made_up(), lambda: "{n}, " + r.choice(_EN_DOES), lambda: r.choice("does could would should shall might were had why how where".split()) + " {n} " + self.made_up() + r.choice(["", " it", " the " + self.made_up()]), lambda: "{n} " + r.choice("is was has had will can may must".split()) + " " + self.made_up(), lambda: "{n} and {n} " + r.choice(_EN_DOES),
        ])()

    def about_thing(self, zh: bool) -> str:
        """The same about things: nothing in it is a value."""
        r = self.r
        if zh:
            x = lambda: r.choice(HAN_NOUNS) if r.random() < 0.5 else self.han_word() if r.random() < 0.5 else r.choice(_SURNAME_WORDS)
            return r.choice([lambda: x() + r.choice(_ZH_DOES), lambda: r.choice(_ZH_WITH) + x() + r.choice(_ZH_DOES), lambda: r.choice(_ZH_WITH) + x(), lambda: x() + "和" + x() + r.choice(_ZH_DOES), lambda: r.choice(_ZH_WITH) + "的" + x(), lambda: x() + "的" + x() + r.choice(_ZH_DOES)])()
        x = lambda: self.made_up() if r.random() < 0.6 else r.choice(NOUNS)
        the = lambda: r.choice(["the", "the", "a", "this", "that", "every", "no", "our", "some"])
        y = lambda: r.choice([f"{the()} {x()}", f"{the()} {x()} {x()}", f"{the()} {x()} {x()}", f"{the()} {x()} of {the()} {x()}", "it", "them", "us", "you", "somebody", "nobody", "everyone"])
        return r.choice([lambda: f"{y()} {r.choice(_EN_DOES)}", lambda: f"{r.choice(_EN_WITH)} {y()}", lambda: f"{r.choice(_EN_WITH)} {y()} {r.choice(_EN_DOES)}", lambda: f"{y()} {r.choice(['will', 'has', 'is', 'was', 'said', 'can', 'and'])} {x()}", lambda: f"{r.choice(_EN_WITH)} {r.randrange(2, 900)} {x()} {x()} {r.choice(['and', 'or', 'but', 'is', 'was', 'with'])} {y()}", lambda: f"{x()} {x()} and {x()} {x()} {r.choice(_EN_DOES)}"])()

    def odd(self) -> str:
        """What is no speech: notes of sounds, hesitation, codes, other scripts."""
        r = self.r
        alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"
        return r.choice([
            lambda: r.choice("[(<*") .join(["", r.choice("applause laughter noise crosstalk music silence inaudible coughs cheering typing".split())]) + r.choice(["]", ")", ">", "*"]),
            lambda: r.choice("（【[") + r.choice("笑声 掌声 噪音 咳嗽 音乐 静音 听不清 敲门声".split()) + r.choice("）】]"), lambda: "♪ music ♪", lambda: r.choice(_SOUNDS) + r.choice(["...", "", ", ", "、", "……", " ", ","]) + r.choice([*_SOUNDS, ""]) + r.choice(["", ".", ",", "…", "！"]), lambda: r.choice("、，…。 ").join(r.choice("嗯 嗯嗯 呃 额 啊 哦 唔".split()) for _ in range(r.randrange(1, 4))), lambda: ", ".join(r.choice(_SOUNDS[:14]) for _ in range(r.randrange(1, 4))), lambda: r.choice(["Speaker {}: ", "发言人 {}： ", "S{}: "]).format(r.randrange(1, 9)) + r.choice(_SOUNDS) + " " + self.about_thing(False),
            lambda: "".join(r.choice(alphabet) for _ in range(r.randrange(8, 400))), lambda: "".join(r.choice(alphabet + alphabet.upper()) for _ in range(r.randrange(3, 12))) * r.randrange(2, 40), lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randrange(7, 40))), lambda: (self._syllable() + self._syllable()) * r.randrange(3, 80), lambda: r.choice(["x ", "a ", "ok ", "la ", "- ", "xx "]) * r.randrange(4, 60),
            lambda: "".join(r.choice("абвгдежзийклмнопрстуфхцчшщыьэюя") for _ in range(r.randrange(2, 12))).capitalize() + " " + "".join(r.choice("абвгдежзиклмнопрст") for _ in range(5)) + ".",
            lambda: f"{'.'.join(str(r.randrange(256)) for _ in range(4))} port {r.randrange(80, 9999)}", lambda: f"{r.randrange(1, 9)}\N{VARIATION SELECTOR-16}\N{COMBINING ENCLOSING KEYCAP}", lambda: "commit " + "".join(r.choice("0123456789abcdef") for _ in range(10)) + " reverts it", lambda: f"https://{self._syllable()}.test/{self._syllable()}?{self._syllable()}={r.randrange(99)}",
        ])()

    def product(self) -> str:
        r = self.r
        a, b = self._syllable() + (self._syllable() if r.random() < 0.4 else ""), r.choice("Gate Hook Cache Board Vault Sync Scribe Mesh DB OS Hub Stack Guide".split()) if r.random() < 0.4 else self.made_up().capitalize()
        return r.choice([a.capitalize() + b, a + "-" + b.lower(), a + " " + b.lower(), (a + "_" + b).upper(), a + b.lower(), a.capitalize() + " " + b])

    def other(self, zh: bool) -> str:
        """Something that looks like a value and is none."""
        r = self.r
        ip = ".".join(str(r.randrange(256)) for _ in range(4))
        if zh:
            return r.choice([
                f"工单 {r.choice(['INC', 'BUG', 'REQ'])}-{self.digits(5)}-{self.digits(4)} 还没关", f"追踪号 {self.digits(13)}", f"追踪号 {self.digits(r.randrange(10, 19))}", f"构建 {r.randrange(2020, 2035)}{self.digits(4)}.{self.digits(3)} 通过了", f"转发地址是 {ip}",
                f"一共 {r.randrange(1, 10)},{self.digits(3)},{self.digits(3)} 帧", f"版本 v{r.randrange(9)}.{r.randrange(40)}.{r.randrange(9)} 发布了", f"会议在 2031-0{r.randrange(1, 9)}-1{r.randrange(9)} {r.randrange(10, 23)}:{r.randrange(10, 59)}", "手机号已经换成 [PHONE]", "邮箱已经替换成 [EMAIL]",
                f"订单编号 {self.digits(12)}", f"现在跑在 {self.product()} 上面", f"总价是 {self.digits(5)} 元", f"提交 {self.digits(3)}af{self.digits(4)}c 已经回滚", f"{self.product()} 的日志里有新的错误", f"升级 {self.product()} 之后缓存坏了",
            ])
        return r.choice([
            f"ticket {r.choice(['INC', 'BUG', 'REQ'])}-{self.digits(5)}-{self.digits(4)} is still open", f"build {r.randrange(2020, 2035)}{self.digits(4)}.{self.digits(3)} passed", f"the tracking number is {self.digits(13)}", f"the trace {self.digits(r.randrange(10, 19))} is gone", f"it forwards to {ip}", f"we counted {r.randrange(1, 10)},{self.digits(3)},{self.digits(3)} frames",
            f"ping @channel about v{r.randrange(9)}.{r.randrange(40)}.{r.randrange(9)}", f"commit {self.digits(3)}af{self.digits(4)}c reverts it", f"the session ran 2031-0{r.randrange(1, 9)}-1{r.randrange(9)} {r.randrange(10, 23)}:{r.randrange(10, 59)}", "the address was already replaced by [EMAIL]", "the number is [PHONE] now", f"the upload now runs on {self.product()}",
            f"the logs of {self.product()} show a late queue", f"after the upgrade {self.product()} broke the cache", f"on {r.choice(['Tuesday', 'Friday', 'Monday'])} we deploy {self.product()} to check the ledger", f"it is due by {r.choice(['Friday', 'Tuesday', 'the end of May', 'June'])}", f"order {self.digits(12)} was shipped", f"we paid {self.digits(5)} dollars", f"by {r.choice(['Friday', 'Monday'])} we split the meeting room twice",
            f"nobody measured the buffer in {r.choice(['May', 'April', 'June'])}", f"according to the {self.product()} it is done", f"that was a joke by the {r.choice(['scribe', 'moderator', 'steward'])}",
        ])


# Speech without persons, in which anything may stand in a noun's place.
_ZH_PLAIN = [
    "{x}没有人{v}{y}", "{x}要不要{v}，还是先{v}{y}", "我担心的是{x}", "我们{x}先把{y}{v}一下", "那个，就是{x}", "{y}把{x}弄坏了", "一共{v}了{d}个{x}", "谁来{v}{x}和{y}", "如果{x}失败，就{v}{y}", "{x}现在还是{y}的那一份", "{x}都已经{v}完了", "本文说明{x}与{y}怎样配合工作", "大家讨论了很久{x}的问题",
    "{x}也坏了", "{x}会变慢", "还是等{x}再说", "{x}和{y}都{v}过了", "与其{v}{x}，不如{v}{y}", "{x}需要{d}分钟才能{v}", "每个{x}都有自己的{y}", "{x}说明", "{y}里有{x}", "{x}提前了", "{x}的日志", "请{v}{x}", "找一下{x}", "{x} 的日志里有 {y}", "新的{x}",
    "{x}在{y}里", "把{x}交给{y}", "{x}说明{y}", "谁来{v}{x}", "先{v}{x}，再{v}{y}", "这个{x}比{y}好", "从{x}到{y}", "{x}跟{y}不一样", "我们让{x}先{v}", "请看{x}", "听{x}的声音", "由于{x}", "和{x}一起{v}", "{x}提示{y}", "对{x}的要求", "{x}{v}完成了", "据{x}显示", "被{x}{v}了",
]
_EN_PLAIN = [
    "{A} {x} and {a} {y} are here", "I think {x} is {a} now", "I mean the {x} is not {a}", "you know, the {x} was {a}", "the {x} is, I guess, {a}", "Maybe I should {v} the {x}", "I said I would {v} the {y}", "Some {x} may {v} the {y}", "Will you {v} the {x}", "May we {v} it",
    "Mark this {x} and call it {a}", "Mark it {a}", "keep it as {a} and go on", "we saw it as {a} and {v} it", "as {a} and {a} as the {x}", "and {a} or {a} {x} too", "either {a} or {v}", "they {v} and {v} all day", "go {v} and come back", "Mark a {x} so that we can {v} it", "keep the {x} as {a} as the {y}", "call that {x} {a} and {v} it", "treat every {x} like a {y}", "Well, I {v} it, like, twice", "Hope this {x} is {a}", "Bill the {x} for the {y}", "Chase the {x} again",
    "{V} the {x} once, then {v} the {y}", "{V} it before noon", "{V} each {x} twice", "{X} after {x}, the {y} got {a}", "{X} is what we {v}", "{A} or not, the {x} stays", "Today the {x} is still {a}", "Whether {x} or {y} is {a}, I can not say", "{D} {x} went to the {y}", "Overall, the {x} was {a}",
    "Somebody has to {v} the {x}", "Everyone saw the {x}", "Both {x} and {y} look {a}", "However, {x} is {a}", "In the {x} there is a {y}", "On {y} we {v} {x}", "There is no {x} in May", "By June the {x} is {a}", "I like the {a} {x}, I really do", "let me {v} that {x}", "we never {v} a {a} {x}", "is the {x} {a} or does it {v}",
    "ask again when the {x} is {a}", "ask for the {x}", "according to the {x}, the {y} is {a}", "talk about the {x}", "thanks for the {x}", "call the {x} from the {y}", "write to the {x}", "send the {a} {x} to the {y}", "that was said by the {y}", "the {x} will take a while", "the {x} said nothing",
]
# Common words that begin with a family name's character.
_SURNAME_WORDS = "解码器 解决 路线图 路由 时间轴 时候 周一 周二 周三 周五 上周 段落 段子 方案 方面 安排 安静 常用 程序 成功 单元 白板 黄色 金额 高级 高度 温度 计划 计算 万一 全部 全局 应该 平台 水平 项目 管理 向量 古典 师傅 文件 文档 牛奶 马上 毛病 连接 任务 任何 明天 包括 查看 查询 房间 许多 何时 田地 江边 石头 和平 元素 能够 宫殿 严重 张贴 陈旧 杨树 朱红 林地 罗列 梁柱 宋体 唐装 冯河 余额 叶子 苏打 丁字 范围 付款 秦腔 江水 史料 顾虑 顾客 钱包 覃塘 武器 莫非 孔洞 汤水 康复 施工 樊笼 葛根 齐全 易用 庄园 章节 鲁莽 岳母 申请 关闭 关键 焦点 左边 祝贺 宁静 符号 纪要 童年 毕业 季度 游标 项链 单词 习惯 阳光 经过 于是 华丽 左侧 席位 米饭 卫生 于今 党员 柏油 强制 冷却 商量 司机 边缘 师生 和谐 农场 巫术 桑叶 利益 向下 后面 路标 晏然 沈默".split()
_LOAN = "Zürichhaus Doppelgänger Übermut Jalapeño Crème Façade Señal Déjà Café Tölpel Smörgås Brûlée Piñata Soufflé".split()


# {n} name, {e} email, {p} phone, {a} address, {k} what a number is called, {i} that number
_EN = [
    "please ask {n} first", "ask {n} about it", "according to {n} it is done", "according to {n} nothing is left", "according to {n} it works", "according to {n} we are late", "according to {n} the work is done", "so according to {n} it will do", "{n} will take the ticket", "{n} will look into it", "that was a joke by {n}", "a remark by {n}", "{n} said it is ready", "as {n} said last week", "I spoke to {n} about the queue",
    "the review goes to {n}", "{n} and {n} agreed on it", "thanks to {n} for the notes", "talk to {n} before you merge", "this was written by {n}", "we are waiting for {n}", "{n} asked for a copy", "assign it to {n}", "my name is {n}", "hello {n}", "{n} has the keys", "let us hear from {n}", "{n} noted it and {n} signed it",
    "you can reach me at {e}", "copy {e} on the notes", "send the export to {e}", "the invite went to {e} by mistake", "my email is {e}", "write to {e}", "email {e} for access", "it was sent from {e}",
    "call me on {p}", "my number is {p}", "text {p} when it is done", "the phone number {p} rings out", "reach us under {p}", "dial {p} to join", "his mobile is {p}",
    "the form still shows {k} {i}", "she wrote down {k} {i}", "for the badge they need {k} {i}", "his {k} is {i}", "{k}: {i}", "enter {k} {i} here",
    "he lives at {a} now", "ship the microphone to {a}", "the workshop moved to {a}", "deliver it to {a}", "our office is at {a}", "the parcel went to {a}", "we met at {a}",
]
_ZH = [
    "请{n}跟进", "请{n}来确认", "{n}说已经完成", "{n}说没有问题", "刚才是{n}提的", "刚才是{n}提的建议", "这件事找{n}确认", "这件事由{n}负责", "找{n}要一份", "问一下{n}", "联系{n}处理", "{n}负责后面的安排", "据{n}反馈", "和{n}对过了", "{n}已经看过", "这是{n}写的", "交给{n}处理", "感谢{n}的整理", "{n}和{n}都同意", "抄送{n}", "我叫{n}", "{n}会跟进", "让{n}再看一遍", "{n}补充了两点", "姓名：{n}",
    "我的邮箱是 {e}", "抄送 {e} 就行", "把导出文件发到{e}", "邀请误发给了{e}", "邮件发到 {e}", "联系邮箱：{e}",
    "我的手机是{p}", "我的手机是 {p}", "打{p}找我", "电话 {p} 没人接", "手机号{p}", "有事拨打{p}", "联系电话：{p}", "号码是{p}",
    "登记用的{k} {i}", "登记用的{k}：{i}", "报名表上写着{k} {i}", "记录里留了{k} {i}", "记录里留了{k}：{i}", "登记用的{k}是{i}", "{k}{i}", "他的{k}是 {i}", "记录里留了{k}{i}",
    "麦克风寄到{a}", "他现在住在{a}", "研讨会改在{a}", "快递寄到{a}", "办公室在{a}", "地址是{a}", "住址：{a}",
]


# Hesitation sounds.
_SOUNDS = "hmm um uh er erm mm mhm Hmm Um Uh Er Erm Mm 嗯 嗯嗯 呃 额 啊 哦".split()
# What persons do, and what is done with them: a name may stand before the one and after the other.
_EN_DOES = "thinks otherwise|thinks about it|believes it|feels the same|is out|is back|is in|is on it|were there|were late|hears it|said no|drew this|typed it|joins at noon|asked about it|said so|said it was late|wrote that part|knows the answer|wants a copy|noted it down|left early|joined us|agreed|agrees|disagrees|has the keys|is on leave|is away|was here|will be there|will know|will call back|can help|could help|should know|would like that|did it|does that|made it|took over|takes notes|told me|told us so|gave a talk|came in late|went home|goes first|speaks next|spoke up|owns this|owns that one|runs the meeting|signed it|sent it|found it|fixed it|broke it|reads it|likes it|needs help|helped a lot|explained why|promised that|has asked for it|had an idea|thought so|meant that|forgot it|answered|called yesterday".split("|")
_EN_WITH = "per our|as per|was that|was|were|is|are|can|could|did|does|hear|heard|hear from|see|saw|know|love|cc|greet|credit|blame|copy|bring|pick|prefer|ask|ask for|tell|call|email|ping|meet|meet with|talk to|speak with|thanks|thank|hi|hey|dear|from|with|by|for|to|and|or|said by|led by|owned by|signed by|sent by|assigned to|reported by|next to|waiting for|invite|remind|let|have|help|join|follow|follow up with|hand it to|give it to|leave it with|pass it to|it was|this is|that is|here is|I am|who is|where is|is that|but|because|so|when|if|until|before|after".split("|")
_ZH_DOES = "认为没问题|觉得还好|表示|指出|强调|提到|打算|决定|准备|正在|已经|刚才|昨天|今天|上周|想|想问|把|把这个|弄|弄好了|笑|讲话|帮忙|开始|继续|接着|代表|领导|安排|处理|查|查过|收到|拿走|寄来|的帮忙|的电话|的问题|的方案|说好了|说不行|说没有|提过|提了一下|写过|写的|改过|看过|问过|来了|走了|去了|不在|在|到了|迟到了|请假了|出差了|休假|同意|反对|支持|建议|建议先停|负责|负责这个|跟进|确认过|回复了|回答|解释了|主讲|主持|介绍|参加|加入|离开|汇报|记录|整理|补充|担心|希望|想要|需要|知道|记得|忘了|发现|完成了|修好了|提交了|签了字|转给我|的意见|的邮件|的看法|的工位|那边|这边|他们|等人|和我|老说|总说|先讲|再讲|来讲|来做|来改|可以做|会做|会来|要来|没来".split("|")
_ZH_WITH = "早上和|会后跟|昨天和|上次|先请|再问|已经告诉|要感谢|主讲是|记录人是|负责的是|不是|是不是|原来是|请|找|让|叫|问|由|据|给|跟|和|与|对|向|把|被|替|同|陪|等|约|派|选|谢谢|感谢|通知|提醒|联系|邀请|抄送|转给|交给|发给|留给|告诉|听|听说|看到|见到|遇到|据说|比如|包括|还有|以及|我是|这是|那是|就是|不是|他叫|我叫|作者|作者：|负责人|负责人：|联系人|组长|姓名|签名：|致|来自|归|属于".split("|")

# Templates that no training text is made of: held-out accuracy is measured on texts of these alone.
_EN_HELD = [
    "can {n} join us later", "I will check with {n} tomorrow", "{n} wrote the draft", "we should thank {n} for that", "was it {n} who broke it", "{n} is out this week", "send it over to {n}", "the idea came from {n}", "{n} thinks it is fine", "did you hear what {n} told us", "per {n}, we can close it", "{n} and {n} were in the room",
    "forward it to {e}", "drop a line to {e}", "the list owner is {e}", "replies go to {e}", "ring {p} after lunch", "the hotline is {p}", "his office line {p} is busy", "leave a message at {p}",
    "the clerk noted {k} {i}", "please confirm {k} {i}", "the scan shows {k} {i}", "they live at {a}", "bring the boxes to {a}", "the depot is at {a}", "meet me at {a}",
]
_ZH_HELD = [
    "{n}明天过来", "先让{n}看看", "{n}刚刚发言了", "谢谢{n}的帮助", "{n}认为可以", "下午和{n}开会", "{n}把文件发来了", "已经通知{n}了", "{n}觉得不行", "麻烦{n}处理", "是{n}弄坏的", "主持人是{n}",
    "发邮件给 {e}", "收件人写{e}", "备用邮箱：{e}", "打电话 {p} 问问", "座机是{p}", "请回拨{p}", "核对一下{k} {i}", "复印件上的{k}是{i}", "搬到{a}了", "送到{a}门口", "公司在{a}", "地点：{a}",
]


def sentences(n: int, seed: int, held_out: bool = False) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts with the ``(start, end, kind)`` of their values; held-out ones share no template of a value with the others."""
    r = random.Random(seed)
    v, m = Values(r), Maker(seed + 1)
    kinds = {"n": "person_name", "e": "email", "p": "phone", "a": "address", "i": "id_number"}
    known = frozenset(NOUNS + VERBS + ADJECTIVES)
    english, chinese = (_EN_HELD, _ZH_HELD) if held_out else (_EN, _ZH)
    out = []
    for _ in range(n):
        zh = r.random() < 0.5
        text, spans = "", []
        people: list[str] = []
        again: list[str] = []  # words that come again
        for k in range(r.choice([1, 1, 2, 2, 3, 3, 7])):
            if text:
                text += r.choice(["，", "。", "， ", " "] if zh else [", ", ". ", ". ", "! "])
            how = r.random()
            if how < 0.08:
                text += v.odd()
                continue
            if how < 0.42:
                if zh:
                    word = lambda: r.choice([r.choice(["周", "星期", "礼拜"]) + r.choice("一二三四五六日") + r.choice(["", "", "之前", "以后", "早上", "下午", "前"]), r.choice(_SURNAME_WORDS), r.choice(_SURNAME_WORDS), r.choice(HAN_NOUNS), r.choice(HAN_NOUNS), v.han_word(), v.han_word(), v.han_word(), v.han_word()])
                    s = v.about_thing(True) if r.random() < 0.25 else r.choice(_ZH_PLAIN) if r.random() < 0.75 else v.han_noise() if r.random() < 0.6 else m.sentence(True)
                    for slot in "xy":
                        again.append(r.choice(again) if again and r.random() < 0.4 else word())
                        s = s.replace("{" + slot + "}", again[-1])
                    s = s.replace("{v}", r.choice(HAN_VERBS)).replace("{d}", str(r.randrange(2, 99)))
                    if r.random() < 0.3:  # without signs, one sentence runs into another
                        s = s.replace("，", "") + r.choice(["", "嗯", "啊", "呃"]) + r.choice(_ZH_PLAIN).replace("，", "").replace("{x}", word()).replace("{y}", word()).replace("{v}", r.choice(HAN_VERBS)).replace("{d}", "7")
                    text += s
                else:
                    if r.random() < 0.25:
                        s = v.about_thing(False)
                    elif r.random() < 0.55:
                        s = r.choice(_EN_PLAIN)
                        x, y, a, verb = r.choice(NOUNS), r.choice(NOUNS), r.choice(ADJECTIVES), r.choice(VERBS)
                        x, y, a, verb = (v.made_up() if r.random() < 0.6 else w for w in (x, y, a, verb))
                        for slot, w in (("x", x), ("y", y), ("a", a), ("v", verb), ("X", x.capitalize()), ("A", a.capitalize()), ("V", verb.capitalize()), ("D", r.choice("Two Three Four Five Six Ten Many Few Most".split()))):
                            s = s.replace("{" + slot + "}", w)
                    else:
                        s = m.sentence(False)
                        s = " ".join(v.made_up() if r.random() < 0.1 and w in known else w for w in s.split(" "))
                    s += r.choice(["", "", "", f" with a {r.choice(_LOAN)}", f" with a {r.choice(_LOAN).lower()}", f" in {v.place()}", f" in the {v.place()} office"])
                    s = r.choice(["um", "uh", "erm", "hmm", "so", "okay", "Um", "Uh", "Erm", "Hmm", "So", "Well"]) + r.choice([", ", " "]) + s if r.random() < 0.25 else s
                    if r.random() < 0.2:
                        words = s.split(" ")
                        words.insert(r.randrange(len(words) + 1), r.choice(["I mean", "you know,", ", you know,", "like", "uh", "I guess", "sort of"]))
                        s = " ".join(words)
                    s = r.choice(["Speaker Three: ", "Speaker Five > ", "SPEAKER_02: ", "S1: "]) + s[0].upper() + s[1:] if r.random() < 0.2 else s
                    text += s if r.random() < 0.5 else s[0].upper() + s[1:]
                continue
            if how < 0.56:
                s = v.other(zh)
                text += s if zh or r.random() < 0.5 else s[0].upper() + s[1:]
                continue
            template = r.choice(chinese if zh else english)
            if not held_out and r.random() < 0.55:
                template = v.about_person(zh)
            if not zh and r.random() < 0.4 and not template.startswith("{"):
                template = template[0].upper() + template[1:]
            if r.random() < 0.12:
                text += r.choice(["[00:12] ", "00:00:12,500 --> ", "Speaker 1: ", "发言人 2：", "(3:07) "])
            called, number = v.number(zh)
            i = 0
            while i < len(template):
                if template[i] == "{":
                    slot = template[i + 1]
                    if slot == "n":
                        value = r.choice(people) if people and r.random() < 0.3 else v.han_name() if zh else v.name()
                        people.append(value)
                    else:
                        value = {"e": v.email, "p": lambda: v.phone(zh), "a": lambda: v.address(zh), "k": lambda: called, "i": lambda: number}[slot]()
                    if slot in kinds:
                        spans.append((len(text), len(text) + len(value), kinds[slot]))
                    text += value
                    i += 3
                else:
                    text += template[i]
                    i += 1
        if r.random() < 0.5:
            text += "。" if zh else "."
        if not zh and r.random() < 0.3 and len(text.lower()) == len(text):
            text = text.lower()
        out.append((text, spans))
    return out
