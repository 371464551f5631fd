"""Patterns of functional paragraphs."""

from __future__ import annotations

# Families of patterns, in the order in which they are tried.
ZH_SPONSOR = [r"(本集|本節目|本期|這集).*?(贊助|支持|呈現|提供)", r"(折扣碼|優惠碼|promo\s*code)", r"輸入.*?(折扣|優惠|code)"]
ZH_CTA = [
    r"(訂閱|追蹤|關注|按讚).*(頻道|節目|podcast|youtube|ig|fb)",
    r"(留言|評論|review).*(apple|spotify|itunes|kkbox)",
    r"(每週|每月|weekly|monthly).*(更新|上架)",
    r"(歡迎|記得|別忘了).*(分享|轉發|訂閱)",
    r"(加入|追蹤|follow).*(@|ig|instagram|facebook|fb)",
    r"訂閱方案",
    r"更新頻率",
    r"訂閱平台",
    r"合作聯繫",
]
HOSTING = [r"Hosting\s+provided\s+by", r"Powered\s+by\s+(SoundOn|Firstory|KKBOX)"]
EN_SPONSOR = [r"(sponsored|brought to you|powered)\s+by", r"use\s+code\s+.{1,20}\s+(for|to\s+get)", r"(discount|promo)\s+code", r"\d+%\s+off", r"Sponsors?:"]
EN_CTA = [
    r"(subscribe|follow|like)\s+(to\s+)?(the\s+)?(channel|podcast|show|newsletter)",
    r"(leave\s+a\s+)?(review|rating)\s+(on\s+)?(apple|spotify|itunes)",
    r"sign\s+up\s+(for|at)",
    r"join\s+(our|the)\s+(newsletter|community|circle)",
    r"follow\s+(us\s+)?(on\s+)?(instagram|twitter|x|facebook)",
    r"get\s+email\s+updates",
    r"Learn\s+more\s+about\s+sponsor\s+message\s+choices",
    r"Privacy\s+Policy",
]
EN_PRODUCTION = [r"(produced|edited)\s+by", r"(executive\s+)?producer\s+is", r"This\s+(podcast|episode)\s+was\s+(produced|edited)", r"This\s+episode:"]
EN_SUBSCRIBE = [
    r"Subscribe\s+today\s+at",
    r"For\s+more\s+information\s+on\s+today's\s+episode",
    r"Transcripts?\s+(of\s+each\s+episode\s+)?will\s+be\s+made\s+available",
    r"download\s+.*?\s+app\s+at",
]
URL = r"https?://\S+"
TIMESTAMP = r"\(\d{1,2}:\d{2}(:\d{2})?\)\s*"
SHORT_CTA = ["訂閱", "追蹤", "subscribe", "follow", "更多", "more"]

# What the scorer counts beyond that, and its weights.
SCORE_ZH_SPONSOR = [*ZH_SPONSOR, r"感謝.*?贊助"]
SCORE_EN_SPONSOR = [*EN_SPONSOR, r"special\s+offer", r"exclusive\s+deal"]
PROMO_CODE = [r"promo\s*code[:\s]+\w+", r"discount\s*code[:\s]+\w+", r"coupon\s*code[:\s]+\w+", r"use\s+code\s+[\'\"]?\w+[\'\"]?"]
WEIGHTS = {"sponsor": 0.30, "promo_code": 0.25, "cta": 0.20, "url_density": 0.10, "hosting": 0.15}
SIMILARITY_WEIGHT, EXTRANEOUS = 0.15, 0.3


def portable(pattern: str) -> str:
    """The pattern with Unicode classes spelled out and a dot that excludes line breaks only, so that every engine reads it alike."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two, c = pattern[i : i + 2], pattern[i]
        spelled = {r"\s": r"\s\p{Z}", r"\w": r"\p{L}\p{N}_", r"\d": r"\p{Nd}"}.get(two)
        if spelled:
            out.append(spelled if inside else f"[{spelled}]")
            i += 2
        elif two == r"\S":
            out.append(r"[^\s\p{Z}]")
            i += 2
        elif c == "\\":
            out.append(two if two not in (r"\'", r"\"") else two[1])
            i += 2
        else:
            inside = c == "[" or inside and c != "]"
            out.append("[^\n]" if c == "." and not inside else c)
            i += 1
    return "(?i)" + "".join(out)
