"""Fitting of the line weights of ``boilerplate`` to labelled pages.

Labels come from seeds: whole lines, menu items and forms of lines that are known furniture, and page numbers with what
files repeat next to them; every other line of a labelled page is body. The weights are a logistic regression with few
non-zero entries (L1), fitted on the driver to at most ``PAGES`` different pages, and written as a JSON file that the
operator reads. ``python -m millrace.llm.boilerplate_fit DIR`` fits them to the tables of DIR. The seeds serve labels
only: the operator knows nothing but the weights.
"""

from __future__ import annotations

import json
import math
import re
import sys
from collections import Counter

import numpy as np

from millrace.llm.boilerplate import WEIGHTS_FILE, group_scales, head_lines, line_features, stripped

#: Weights smaller than this are left out.
LEAST_WEIGHT = 0.25
#: Labelled pages at most, occurrences of a feature at least, strength of the L1 penalty, steps.
PAGES, LEAST, PENALTY, STEPS = 20_000, 10, 0.12, 240
# Labelled furniture, in lower case, digits as 0. Menu items by language.
MENU = set(
    """home|menu|search|log in|login|sign in|register|about us|about|contact|contact us|services|departments|residents|business|careers|jobs|news|events|calendar|forms|maps|payments|my account|bids & rfps|bids|faq|help|government|visitors
accueil|à propos|contact|services|actualités|connexion|plan du site|marchés publics|recherche|rechercher|menu|contactez-nous|emplois|s'inscrire
startseite|über uns|kontakt|suche|anmelden|aktuelles|ämter|vergaben|menü|karriere|leistungen|registrieren
inicio|nosotros|contacto|buscar|acceder|noticias|servicios|licitaciones|menú|empleo|mapa del sitio|trámites
главная|о нас|контакты|войти|новости|закупки|услуги|поиск|меню|вакансии
ホーム|会社概要|お問い合わせ|お知らせ|入札情報|ログイン|検索|メニュー|サービス|採用情報
首页|关于我们|联系我们|新闻|招标公告|登录|搜索|菜单|服务|注册
الرئيسية|من نحن|اتصل بنا|الأخبار|المناقصات|بحث|تسجيل الدخول|القائمة|الخدمات
หน้าแรก|เกี่ยวกับเรา|ติดต่อ|ติดต่อเรา|ข่าว|ประกวดราคา|ค้นหา|เข้าสู่ระบบ|เมนู|บริการ
मुखपृष्ठ|हमारे बारे में|संपर्क|समाचार|निविदाएँ|खोज|लॉग इन|मेनू|सेवाएँ""".replace("\n", "|").split("|")
)
#: Whole lines: notices and their buttons, side content, footers.
LINES = set(
    """skip to main content|skip to content|skip navigation|toggle menu|toggle navigation|an official website|employee intranet|sign up for our newsletter|back to top|site map|sitemap|this site is best viewed in a modern browser
ada notice|report a problem with this page|all rights reserved|share this page|share|most viewed|most popular|download the app|you may also like|popular searches|quick links|follow us|recent posts|print|print this page|listen to this page
was this page helpful?|related notices|related articles|upcoming meetings|text size: a a a|pay a bill online|vendor login|translate|advertisement|subscribe to alerts|subscribe|got it|accept all|accept all cookies|reject all|reject non-essential|manage preferences|cookie settings
only what is required|everything|ok, close this message|learn how we handle personal data|your privacy matters to us. choose which categories you allow|this website stores small files on your device|this page relies on small text files kept by your browser
we use cookies to improve this site. by continuing you accept them|some features need cookies, read our policy for details|tracking helps us count visits. you can opt out at any time|privacy policy|terms of use|accessibility|privacy|terms|cookie policy
tout accepter|tout refuser|paramétrer les traceurs|ce site utilise des cookies. en poursuivant, vous les acceptez|mentions légales|confidentialité|tous droits réservés|haut de page|partager|s'abonner|voir aussi|liens rapides|politique de confidentialité
alle akzeptieren|alle ablehnen|einstellungen anpassen|diese seite verwendet cookies|impressum|datenschutz|alle rechte vorbehalten|nach oben|teilen|abonnieren|siehe auch|schnellzugriff|datenschutzerklärung
aceptar todo|rechazar todo|configurar|usamos cookies para mejorar el sitio. al continuar, las acepta|aviso legal|privacidad|todos los derechos reservados|volver arriba|compartir|suscribirse|ver también|enlaces rápidos|política de privacidad
принять все|отклонить все|настроить|сайт использует файлы cookie|политика конфиденциальности|карта сайта|все права защищены|наверх|поделиться|смотрите также|подписаться|быстрые ссылки
同意する|すべて拒否|当サイトはクッキーを使用します|プライバシーポリシー|サイトマップ|共有する|関連情報|ページの先頭へ|無断転載禁止
全部接受|全部拒绝|本网站使用cookie|隐私政策|网站地图|分享|相关公告|返回顶部|版权所有
قبول الكل|رفض الكل|يستخدم هذا الموقع ملفات الارتباط|سياسة الخصوصية|خريطة الموقع|شارك|مواضيع ذات صلة|جميع الحقوق محفوظة
ยอมรับทั้งหมด|ปฏิเสธทั้งหมด|เว็บไซต์นี้ใช้คุกกี้|นโยบายความเป็นส่วนตัว|แผนผังเว็บไซต์|แชร์|ประกาศที่เกี่ยวข้อง|สงวนลิขสิทธิ์
स्वीकार करें|अस्वीकार करें|यह साइट कुकी का उपयोग करती है|गोपनीयता नीति|साइट मैप|साझा करें|संबंधित सूचना|सर्वाधिकार सुरक्षित""".replace("\n", "|").split("|")
)
#: Forms of lines, digits as 0, case kept.
FORMS = [
    re.compile(p)
    for p in (
        r"(?i)(©|\(c\)|copyright)\s*0\b.{0,60}$",
        r"(?i)powered by \S.{0,40}$",
        r"v0(\.0)+$",
        r"(?i)(phone|tel|telephone|fax): ?[+0() -]+$",
        r"(?i)webmaster: \S+$",
        r"(?i)office hours: .{0,40}$",
        r"(?i)last (updated|modified|reviewed):? .{0,30}$",
        r"(?i)member of the .{3,60} (council|association|league|network)$",
        r"0+ [A-Z][a-z]+ (Street|St\.|Avenue|Ave\.|Road|Rd\.|Boulevard|Blvd\.|Lane|Drive), .{3,40}$",
        r"(?i)we and our 0 partners .{0,80}$",
        r"(?i)your consent applies to \S+$",
        r"(?i)leave a comment( \(0\))?$",
        r"(?i)tags: .{2,80}$",
        r"(?i)read more about .{2,60}$",
        r"(?i)sponsored by .{2,60}$",
        r"(?i)weather: .{0,20}0 degrees$",
        r"[A-Z][a-z]+ 0, 0 - (Council|Board|Committee) meeting$",
        r"(?i)(bid|rfp) 0-0 closes soon$",
        r"(?i)(only what is required|accept|reject)\s*\|\s*\S.{0,30}$",
        r"(X-ray |[a-z])[\w -]{2,50} \(0\)$",
        r"(?!(Request|Invitation|Notice|Solicitation|Program|Fee|Frequently|Contact|Item|Call|Statement|Public|Job|Press)\b)[A-Z][a-z]+( [A-Z][a-z]+){1,2}: (X-ray |[a-z])[\w -]{2,50}$",
    )
]
#: Furniture of other sites, one line an example: menus, notices, side content, footers.
OTHERS = """home | products | support | community
shop | cart | checkout | wishlist
about | team | press | investors | careers
features | solutions | customers | resources | company
sports | weather | opinion | video | podcasts
categories | archives | tags | authors
produkte | tarife | magazin
produkte | lösungen | unternehmen | presse
produits | tarifs | boutique | panier | blog
productos | precios | tienda | carrito
продукты | блог | магазин
製品 | ブログ | サポート
产品 | 博客 | 社区
your choices regarding cookies and trackers
we and our partners store and access information on your device
this website uses cookies to ensure you get the best experience
by clicking accept you agree to the storing of cookies on your device
accept cookies
decline
cookie preferences
do not sell my personal information
wir verwenden cookies und andere technologien
nous utilisons des cookies pour améliorer votre expérience
utilizamos cookies propias y de terceros
newsletter signup
sign up
create account
forgot password
my profile
log out
view cart
add to cart
products
blog
staff directory
search our calendar
search our site
related posts
related stories
trending now
popular now
share on facebook
tweet this
follow us on social media
subscribe to our newsletter
enter your email address
load more
read more
next page
previous page
skip navigation links
contact our webmaster
leave a reply
post a comment
all rights reserved worldwide
terms of service
terms and conditions
privacy notice
legal notice
disclaimer
cookie notice
site by webworks
produkte
panier
warenkorb
merkliste
datenschutzhinweise
conditions générales
términos y condiciones""".split("\n")
_BULLET = re.compile(r"^[•·▪◦*-]\s+")
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"\s*[|·•»›>/]\s*|\s{2,}|\s*\t\s*")
_SEPARATOR = re.compile(r"[|·•»›>/\t]|  ")
_SPACE = re.compile(r"\s+")
_SQUASHED = {_SPACE.sub("", x) for x in LINES}
_STOP = ".。।"
#: First words of notices that a wrapped text may break.
_BEGIN = {x.split()[0] for x in LINES if " " in x} | {"we", "your"}


def _known(low: str) -> bool:
    return low in LINES or low.rstrip(_STOP) in LINES or _SPACE.sub("", low).rstrip(_STOP) in _SQUASHED


def seeded(line: str) -> bool:
    """Whether a stripped line is a seed, a row of seeds, or of a seed's form."""
    plain = _DIGITS.sub("0", _BULLET.sub("", line)).strip()
    low = plain.lower()
    if _known(low) or low in MENU:
        return True
    items = [x.lower() for x in _SPLIT.split(plain) if x] if _SEPARATOR.search(plain) else []
    hits = sum(x in MENU or _known(x) for x in items)
    if len(items) > 1 and (hits >= 2 and hits >= 0.6 * len(items) or hits == len(items) or hits >= 3 and len(items) - hits <= 2):
        return True
    return any(f.match(plain) for f in FORMS)


def labels(lines: list[str], heads: set[int]) -> list[bool]:
    """Whether each of a page's stripped lines is furniture; ``heads`` are its page numbers and running heads."""
    out = [bool(x) and (seeded(x) or i in heads) for i, x in enumerate(lines)]
    for i, x in enumerate(lines):  # notices broken over up to three lines
        if x and not out[i] and x.split(None, 1)[0].lower() in _BEGIN:
            text = x
            for j in range(i + 1, min(i + 3, len(lines))):
                if not lines[j]:
                    break
                text = f"{text} {lines[j]}"
                low = _DIGITS.sub("0", text)
                if _known(low.lower()) or any(f.match(low) for f in FORMS[9:11]):
                    out[i : j + 1] = [True] * (j + 1 - i)
    return out


def fit(texts: list[str]) -> dict[str, float]:
    """Weight of each feature (body above 0, furniture below), fitted to the first ``PAGES`` different of ``texts``."""
    seen: Counter = Counter()
    for text in list(dict.fromkeys(t for t in texts if t))[:PAGES]:
        lines = stripped(text)
        heads = head_lines(lines)
        seen.update((x, i in heads, bad) for i, (x, bad) in enumerate(zip(lines, labels(lines, heads), strict=True)) if x)
    seen.update({(x, False, True): 50 for x in OTHERS})
    made = [line_features(x, head) for x, head, _ in seen]
    often: Counter = Counter()
    for (line, head, bad), groups in zip(seen, made, strict=True):
        n = seen[line, head, bad]
        for g in groups:
            often.update({f: n if f[0] == "=" else min(n, LEAST) if n >= 50 else 1 for f in g})
    names = [f for f, n in often.items() if n >= LEAST]
    place = {f: i for i, f in enumerate(names)}
    rows, cols, vals = [], [], []
    for r, groups in enumerate(made):
        for g, scale in zip(groups, group_scales(groups), strict=True):
            hit = [place[f] for f in g if f in place]
            rows += [r] * len(hit)
            cols += hit
            vals += [scale] * len(hit)
    rows, cols, vals = np.array(rows), np.array(cols), np.array(vals)
    y = np.array([0.0 if bad else 1.0 for *_, bad in seen])
    weight = 1 + np.log([float(n) for n in seen.values()])
    weight /= weight.sum()
    w, m, v = (np.zeros(len(names)) for _ in range(3))
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=vals * w[cols], minlength=len(y)), -30, 30)))
        g = np.bincount(cols, weights=vals * ((p - y) * weight)[rows], minlength=len(w))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.1 if step < 0.75 * STEPS else 0.03
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY, 0.0)
    return {f: round(float(w[i]), 2) for f, i in sorted(place.items()) if abs(w[i]) >= LEAST_WEIGHT}


def main(folder: str) -> None:
    import pyarrow.parquet as pq

    texts = [t for name in ("documents", "extracted_documents") for t in pq.read_table(f"{folder}/{name}.parquet", columns=["text"]).column(0).to_pylist()]
    weights = fit(texts)
    with open(WEIGHTS_FILE, "w", encoding="utf-8") as out:
        json.dump(weights, out, ensure_ascii=False, indent=0, sort_keys=True)
    print(len(weights), "weights")


if __name__ == "__main__":
    main(sys.argv[1])
