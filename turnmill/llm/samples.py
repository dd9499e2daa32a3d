"""Labelled documents that the rules of text kinds are induced on.

No labelled documents come with the corpus, so they are composed here: invented
running text, items, rows and noise in Chinese and English, in the usual shapes
of each kind, mixed in all proportions; the label is what most of a text is.
"""

from __future__ import annotations

import base64
import random

# The invented words that the samples are composed of.
NOUNS = "garden kettle river lantern ladder orchard blanket harbour window bucket carpet saddle basket mirror hammer cellar meadow bridge candle pocket engine ticket bottle wagon curtain sandwich kitchen table mountain market".split()
VERBS = "paint carry repair clean borrow measure cover open close polish collect deliver move cut wash check send print draw weigh".split()
ADJECTIVES = "small heavy green broken quiet narrow empty wooden late early yellow cheap bright careful second public".split()
HAN_NOUNS = "花园 水壶 河流 灯笼 梯子 果园 毯子 港口 窗户 水桶 地毯 篮子 镜子 锤子 地窖 草地 小桥 蜡烛 口袋 发动机 车票 瓶子 马车 窗帘 面包 厨房 桌子 山坡 市场 工作台 说明书 收音机 登记表 练习本".split()
HAN_VERBS = "粉刷 搬运 修理 清洗 借用 测量 遮盖 打开 关闭 擦亮 收集 交付 移动 剪开 检查 发送 打印 称重 登记 核对".split()
HAN_ADJECTIVES = "小的 沉重的 绿色的 破旧的 安静的 狭窄的 空的 木头的 迟到的 黄色的 便宜的 明亮的 仔细的 第二个 公共的 不稳定的 每天的".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def item(self, zh: bool) -> str:
        r = self.r
        n, v, a = (HAN_NOUNS, HAN_VERBS, HAN_ADJECTIVES) if zh else (NOUNS, VERBS, ADJECTIVES)
        gap, the = ("", "") if zh else (" ", r.choice(["", "the "]))
        return r.choice([
            lambda: r.choice(n),
            lambda: r.choice(a) + gap + r.choice(n),
            lambda: r.choice(v) + gap + the + r.choice(n),
            lambda: r.choice(v) + gap + the + r.choice(a) + gap + r.choice(n),
            lambda: r.choice(n) + ("：" if zh else ": ") + r.choice(a) + gap + r.choice(n),
        ])()

    def sentence(self, zh: bool) -> str:
        r = self.r
        if zh:
            n, v, a = HAN_NOUNS, HAN_VERBS, HAN_ADJECTIVES
            return r.choice([
                lambda: f"我们昨天{r.choice(v)}了{r.choice(a)}{r.choice(n)}，现在还没有人去看{r.choice(n)}",
                lambda: f"如果{r.choice(n)}坏了，就{r.choice(v)}{r.choice(n)}",
                lambda: f"谁来{r.choice(v)}{r.choice(n)}和{r.choice(n)}",
                lambda: f"大约有{r.randrange(2, 99)}个{r.choice(n)}是从{r.choice(a)}{r.choice(n)}里拿来的",
                lambda: f"{r.choice(a)}{r.choice(n)}现在还是很{r.choice(['旧', '大', '慢'])}的那一个",
                lambda: f"为什么{r.choice(n)}在{r.choice(['周二', '早上', '节后'])}没有变化，大家到现在也说不清楚",
                lambda: f"每个{r.choice(n)}都有自己的{r.choice(n)}，所以{r.choice(n)}不会受到影响",
                lambda: f"一共{r.choice(v)}了{r.randrange(2, 99)}个{r.choice(n)}",
            ])()
        n, v, a = NOUNS, VERBS, ADJECTIVES
        return r.choice([
            lambda: f"we should {r.choice(v)} the {r.choice(a)} {r.choice(n)} before the {r.choice(n)} is gone",
            lambda: f"it is easier to {r.choice(v)} a {r.choice(n)} than to {r.choice(v)} a {r.choice(a)} {r.choice(n)}",
            lambda: f"nobody wanted to {r.choice(v)} it in the morning, and the {r.choice(n)} stayed {r.choice(a)}",
            lambda: f"they counted {r.randrange(2, 99)} of the {r.randrange(100, 999)} {r.choice(n)} pieces",
            lambda: f"my worry is the {r.choice(a)} {r.choice(n)}, not the {r.choice(n)}",
            lambda: f"can somebody {r.choice(v)} the {r.choice(n)} and the {r.choice(n)}",
            lambda: f"the {r.choice(n)} of the {r.choice(n)} is {r.choice(a)}, but it's enough for the {r.choice(n)}",
            lambda: f"that's why the {r.choice(n)} we found last week has no {r.choice(n)}",
        ])()

    def prose(self, zh: bool, size: int) -> str:
        """At least ``size`` characters of running text in one of its usual shapes."""
        r = self.r
        shape = r.choice(["plain", "plain", "paragraphs", "wrapped", "quoted", "transcript", "bare", "bare_lines", "spaced", "changes"])
        ends = "。！？" if zh else ".!?"
        out: list[str] = []
        while sum(map(len, out)) < size:
            s = self.sentence(zh)
            if shape in ("bare", "bare_lines"):
                s = s.replace("，", " " if r.random() < 0.7 else "").replace(",", "")
                if r.random() < 0.3:
                    s = r.choice(["嗯 ", "那个 "] if zh else ["uh ", "um "]) + s
                out.append(s)
                continue
            s = s if zh else s[0].upper() + s[1:]
            s += ends[0] if r.random() < 0.75 else r.choice(ends)
            if shape == "transcript" and (not out or r.random() < 0.5):
                who = r.choice(["Speaker {}: ", "发言人 {}：", "SPEAKER_0{}: ", "S{}: "]).format(r.randrange(1, 6))
                clock = r.choice(["", f"[00:{r.randrange(10, 59)}] ", f"00:00:{r.randrange(10, 59)},{r.randrange(100, 999)} --> ", f"({r.randrange(9)}:{r.randrange(10, 59)}) "])
                s = ("\n" if out else "") + clock + who + s
            out.append(s)
        if r.random() < 0.3:  # odd things that running text may hold
            odd = ["……", " café", " Новая версия собрана. ", "\U0001f389", "\u00a0", " see INC-20417-0388 ", " 3f9ac02e11 ", " v5.23.1 ", " <|end|> ", "\t\tend.", " https://example.org/a/b?c=1 "]
            out = [s + (r.choice(odd) if r.random() < 0.3 else "") for s in out]
        gap = "" if zh else " "
        if shape == "changes":
            return "\n".join(r.choice(["+ ", "- "]) + s for s in out)
        if shape == "paragraphs":
            return "".join(s + (r.choice(["\n\n", "\r\n\r\n", gap, gap]) if r.random() < 0.6 else gap) for s in out)
        if shape == "spaced":
            return "".join(s + r.choice([gap, "  ", " ", "　", "\t"]) for s in out)
        if shape == "bare_lines":
            lines, line = [], ""
            for s in out:
                line += (" " if line else "") + s
                if len(line) > (24 if zh else 80) and r.random() < 0.3:
                    lines, line = [*lines, line], ""
            return "\n".join([*lines, line] if line else lines)
        text = (" " if shape == "bare" and (not zh or r.random() < 0.7) else gap).join(out)
        if shape in ("wrapped", "quoted"):
            lead = r.choice(["> ", "| ", "    "]) if shape == "quoted" else r.choice(["", "", "    "])
            lead = "> " if lead == "| " else lead
            wide = r.randrange(22, 44) if zh else r.randrange(50, 84)
            lines, line = [], ""
            for piece in text if zh else text.split(" "):
                if len(line) + len(piece) > wide:
                    lines, line = [*lines, line], ""
                line += piece if zh or not line else " " + piece
            return "\n".join(lead + x for x in [*lines, line])
        return text

    def items(self, zh: bool, size: int) -> str:
        r = self.r
        marks = r.choice([
            lambda i: "- ", lambda i: "* ", lambda i: "• ", lambda i: "— ", lambda i: f"{i + 1}. ", lambda i: f"{i + 1}) ", lambda i: f"({chr(97 + i % 26)}) ",
            lambda i: r.choice(["- [ ] ", "- [x] "]), lambda i: f"（{'零一二三四五六七八九'[i % 10]}）", lambda i: f"{9 + i // 4:02d}:{i % 4 * 15:02d} ", lambda i: "  " * (i % 3) + "* ",
            lambda i: "", lambda i: "", lambda i: "",
        ])
        inline = r.random() < 0.2
        stop = r.choice(["", "", "。" if zh else "."])
        out: list[str] = []
        while sum(map(len, out)) < size or len(out) < 4:
            out.append(self.item(zh))
        if inline:
            if r.random() < 0.3:
                return " ".join(f"{i + 1}) {x}" for i, x in enumerate(out)) + stop
            return (r.choice(["、", "、", "；"]) if zh else r.choice([", ", "; ", " / "])).join(out) + stop
        return "\n".join(marks(i) + x + stop for i, x in enumerate(out))

    def table(self, zh: bool, size: int) -> str:
        r = self.r
        wide = r.randrange(2, 7) if r.random() < 0.9 else 2
        names = [r.choice(HAN_NOUNS if zh else NOUNS) for _ in range(wide)]

        def cell() -> str:
            return r.choice([str(r.randrange(9999)), f"{r.random() * 99:.2f}", f"{r.randrange(60):02d}:{r.randrange(60):02d}", "ok", "fail", "-", "", self.r.choice(HAN_NOUNS if zh else NOUNS)])

        kinds = [r.random() < 0.3 for _ in range(wide)]
        rows = [names]
        while sum(len(c) + 3 for x in rows for c in x) < size or len(rows) < 4:
            rows.append([r.choice(HAN_NOUNS if zh else NOUNS) if k or i == 0 else cell() for i, k in enumerate(kinds)])
        form = r.choice(["pipe", "box", "html", "tab", "comma", "semicolon", "pairs", "aligned"])
        if form == "pipe":
            return "\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "---|" * wide, *["| " + " | ".join(x) + " |" for x in rows[1:]]])
        if form == "box":
            bar = "+" + ("-" * 14 + "+") * wide
            return "\n".join([bar, *[y for x in rows for y in ("|" + "|".join(c.ljust(14) for c in x) + "|", bar)]])
        if form == "html":
            return "<table>\n" + "\n".join("<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>" for x in rows) + "\n</table>"
        if form == "pairs":
            return "\n".join(" ".join(f"{n}={c or '-'}" for n, c in zip(names, x)) for x in rows[1:])
        if form == "aligned":
            return "\n".join("".join((c or "-").ljust(16) for c in x).rstrip() for x in rows)
        return "\n".join({"tab": "\t", "comma": ",", "semicolon": ";"}[form].join(x) for x in rows)

    def junk(self, zh: bool, size: int) -> str:
        r = self.r

        def lines(make, gap: str, end: str = "") -> str:
            out = ""
            while len(out) < size:
                out += gap.join(make() for _ in range(r.randrange(6, 16))) + end + "\n"
            return out

        def few() -> str:
            words = r.sample(["好", "对", "啊", "嗯", "行", "喂"] if zh else ["la", "test", "uh", "ok", "yes", "one two", "hello"], r.randrange(1, 4))
            return r.choice(["，", "。", "、", ""] if zh else [", ", " ", ". "]).join(r.choice(words) for _ in range(max(30, size // 4)))

        def again() -> str:
            s = self.sentence(zh) if r.random() < 0.6 else self.item(zh) + ("了" if zh else "")
            gap = r.choice(["。", "", "。\n"] if zh else [". ", " ", ".\n", ". "])
            return gap.join([s] * max(6, size // len(s)))

        word = "abcdefghijklmnopqrstuvwxyz"
        return r.choice([
            lambda: lines(lambda: "".join(r.choice(word) for _ in range(r.randrange(2, 14))), " ", r.choice(["", "."])),
            lambda: lines(lambda: "".join(r.choice("!#$%&*+-./:;<=>?[]^_{|}~\\") for _ in range(6)), ""),
            lambda: lines(lambda: "".join(r.choice("□■◆▯�?#@%089 ") for _ in range(4)), ""),
            lambda: "\n".join("".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(r.randrange(7, 60))) for _ in range(max(3, size // 40))),
            lambda: base64.encodebytes(r.randbytes(size * 3 // 4)).decode(),
            lambda: "\n".join(f"{i * 16:08x}  " + " ".join(f"{b:02x}" for b in r.randbytes(16)) for i in range(max(3, size // 50))),
            lambda: r.randbytes(size // 2).hex(),
            lambda: self.prose(True, size // 2).encode().decode("latin-1"),
            lambda: self.prose(True, size // 2).encode().decode("cp1252", "replace"),
            lambda: self.prose(True, size // 2).encode("gbk", "replace").decode("latin-1"),
            lambda: "".join(r.choice(word + word.upper() + "0123456789") for _ in range(size)),
            few, few, again, again,
        ])()


def labelled_documents(n: int, seed: int) -> list[tuple[str, str]]:
    """``n`` pairs of text and label."""
    m = Maker(seed)
    r, out = m.r, []
    for i in range(n):
        kind = ("prose", "prose", "list", "table", "junk")[i % 5]
        zh = r.random() < 0.5
        size = int(10 ** r.uniform(1.9, 3.4) if kind != "prose" else r.uniform(1.2, 3.6))
        make = {"prose": m.prose, "list": m.items, "table": m.table, "junk": m.junk}[kind]
        text = make(zh, size)
        if kind in ("list", "table", "prose") and r.random() < 0.45:
            # a smaller part of another kind before or after
            other = m.prose if kind != "prose" else r.choice([m.items, m.table])
            part = other(zh, int(len(text) * r.uniform(0.05, 0.6)))
            if len("".join(part.split())) < 0.5 * len("".join(text.split())):
                text = r.choice([lambda: text + "\n" + part, lambda: part + "\n" + text, lambda: part + "\n\n" + text])()
        if r.random() < 0.1:
            text = ("# " if r.random() < 0.5 else "") + m.item(zh) + "\n\n" + text
        out.append((text, kind))
    return out
