"""Labelled example pages, and the words in names by the kind of part they speak of.

An element of class ``yes`` is content, one of class ``no`` is not, and so is all below it
unless it says otherwise.
"""

# Words in class, id and role attributes.
NAMES = {
    "menu": {"nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs",
             "pagination", "pager", "toc", "tabs", "toolbar", "skip"},
    "header": {"header", "masthead", "banner", "topbar", "logo", "branding", "site-header"},
    "footer": {"footer", "colophon", "copyright", "legal", "bottom", "contentinfo", "imprint"},
    "sidebar": {"sidebar", "aside", "rail", "widget", "widgets", "complementary", "related",
                "recommended", "popular", "trending", "secondary", "more", "tags", "archive"},
    "notice": {"notice", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal",
               "overlay", "disclaimer", "paywall", "toast", "warning", "announcement"},
    "advert": {"ad", "ads", "adv", "advert", "advertisement", "adsense", "sponsor", "sponsored",
               "promo", "promotion", "promoted", "outbrain", "taboola", "banner-ad"},
    "form": {"form", "search", "searchbox", "login", "signup", "subscribe", "subscription",
             "newsletter", "register", "contact", "share", "sharing", "social"},
    "comment": {"comment", "comments", "commentlist", "respond", "reply", "replies", "disqus",
                "discussion", "reviews", "feedback"},
    "content": {"article", "content", "entry", "post", "story", "main", "body", "text", "prose",
                "articlebody", "maincontent", "blogpost", "page-content"},
}

_LONG = "words of a sentence that runs on for some time and then comes to its end. " * 6
_SOME = "a shorter sentence of the text, with some more words in it. "
_FEW = "two words "
_LINKS = "<ul>" + "<li><a href='/x'>a link</a></li>" * 5 + "</ul>"
_BODY = f"<h1>{_FEW}</h1><p>{_LONG}</p><p>{_SOME}</p><h2>{_FEW}</h2><p>{_LONG}<a>a link</a></p>"
_LISTS = (
    f"<ul><li>{_SOME}</li><li>{_FEW}</li></ul><ol><li>{_SOME}</li><li>{_SOME}</li></ol>"
    f"<blockquote><p>{_SOME}</p></blockquote><pre>{_SOME}</pre><dl><dt>{_FEW}</dt><dd>{_SOME}</dd></dl>"
    f"<table><tbody><tr><th>{_FEW}</th><td>{_FEW}</td></tr><tr><td>{_FEW}</td><td>{_FEW}</td></tr></tbody></table>"
    f"<figure><figcaption>{_SOME}</figcaption></figure><section><h3>{_FEW}</h3><p>{_LONG}</p></section>"
    f"<div><p>{_LONG}</p></div><p>{_FEW}</p><h4>{_FEW}</h4><p>{_SOME}</p><div>{_SOME}</div>"
)
_TOP = (
    f"<header class='no'><div class='logo'>{_FEW}</div><nav>{_LINKS}</nav><p>{_FEW}</p></header>"
    f"<nav class='no'>{_LINKS}</nav>"
)
_SIDE = (
    f"<aside class='no'><h3>{_FEW}</h3>{_LINKS}<p>{_SOME}</p><div>{_SOME}</div></aside>"
    f"<div class='no sidebar'><h3>{_FEW}</h3><p>{_SOME}</p>{_LINKS}</div>"
)
_APART = (
    f"<div class='no cookie-notice'><p>{_SOME}</p><div>{_SOME}</div></div>"
    f"<div class='no advert'>{_SOME}</div><div class='no ad'><p>{_SOME}</p></div>"
    f"<form class='no'><p>{_FEW}</p><div>{_SOME}</div><fieldset><legend>{_FEW}</legend></fieldset></form>"
    f"<div class='no newsletter'><h3>{_FEW}</h3><p>{_SOME}</p></div>"
)
_COMMENT = f"<div class='no comment'><h4>{_FEW}</h4><p>{_SOME}</p><p>{_LONG}</p></div>"
_COMMENTS = (
    f"<section class='no comments'><h2>{_FEW}</h2>{_COMMENT}{_COMMENT}"
    f"<ol><li><p>{_LONG}</p></li><li><article class='no comment'><p>{_LONG}</p></article></li></ol></section>"
    f"<div class='no comments'><h3>{_FEW}</h3><ul><li>{_SOME}</li><li>{_LONG}</li></ul><p>{_SOME}</p></div>"
)
_END = (
    f"<footer class='no'><p>{_FEW}</p><p>{_SOME}</p>{_LINKS}<div>{_SOME}</div></footer>"
    f"<div class='no footer'><p>{_SOME}</p><div>{_FEW}</div></div>"
)


def _page(body: str) -> str:
    return f"<html><head></head><body>{body}</body></html>"


PAGES = [
    _page(f"{_TOP}<main class='yes'><article class='yes'>{_BODY}{_LISTS}</article></main>{_SIDE}{_END}"),
    _page(f"{_TOP}<article class='yes'>{_BODY}{_APART}<p>{_LONG}</p>{_LISTS}</article>{_COMMENTS}{_END}"),
    _page(f"{_APART}<article class='yes'><header class='yes'><h1>{_FEW}</h1><p>{_SOME}</p></header>"
          f"<p>{_LONG}</p>{_LISTS}{_SIDE}<p>{_SOME}</p>{_COMMENTS}{_END}</article>{_END}"),
    _page(f"<div class='no header'><p>{_FEW}</p></div><div class='no menu'>{_LINKS}</div>"
          f"<div class='yes content'>{_BODY}{_LISTS}</div>{_SIDE}{_END}"),
    _page(f"{_TOP}<div><div>{_APART}<div class='yes post'><h2>{_FEW}</h2><div class='yes entry'>"
          f"<p>{_LONG}</p><p>{_LONG}</p>{_LISTS}</div></div>{_COMMENTS}</div>{_SIDE}</div>{_END}"),
    _page(f"<div class='no'>{_LINKS}</div><div class='yes'>{_BODY}{_LISTS}</div><div class='no'>{_LINKS}</div>"),
    _page(f"<h1 class='yes'>{_FEW}</h1><p class='yes'>{_LONG}</p><p class='yes'>{_SOME}</p>"
          f"<p class='yes'>{_LONG}</p><h2 class='yes'>{_FEW}</h2><p class='yes'>{_LONG}</p>"),
    _page(f"<table><tbody><tr><td class='no'>{_LINKS}</td><td class='yes'>{_BODY}{_LISTS}</td></tr></tbody></table>"),
    _page(f"{_TOP}<section class='yes'>{_BODY}<p>{_SOME}</p></section><section class='no related'>"
          f"<h3>{_FEW}</h3>{_LINKS}</section>{_APART}{_END}"),
    _page(f"<article class='yes'><h1>{_FEW}</h1><p>{_FEW}</p><nav class='no'>{_FEW}</nav><p>{_SOME}</p>"
          f"<aside class='no'><p>{_SOME}</p></aside><nav class='no'>{_LINKS}</nav><p>{_SOME}</p>"
          f"<aside class='no'>{_SOME}</aside><footer class='no'>{_FEW}</footer></article>"),
    _page(f"<div><article class='yes'><h1>{_FEW}</h1><p>{_SOME}</p><div class='no comment'><p>{_SOME}</p></div>"
          f"<footer class='no'><p>{_FEW}</p></footer></article><div class='no comment'><article class='no comment'>"
          f"<p>{_SOME}</p></article><article class='no comment'><p>{_LONG}</p></article></div></div>"),
]
