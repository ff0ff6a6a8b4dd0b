"""Patterns that several rules share, put together from word lists. All are Java patterns; those for SQL are plain enough for RE2 too."""

from __future__ import annotations


def _any(words: str) -> str:
    return "(?:" + "|".join(words.split("/")) + ")"


#: BCP 47: a language of two or three letters or a private one, then subtags.
LANGUAGE = r"^(?:[A-Za-z]{2}[A-Za-z]?|x)(?:-(?:[0-9A-Za-z]){1,8})*$"

_DAY, _SEP = r"\d{1,2}", "[-./]"
FILE_ENDING = r"\." + _any("ai/docx?/indd/pdf/pptx?/psd/xlsx?") + "$"
DATE = f"^{_DAY}{_SEP}{_DAY}{_SEP}" + r"\d{2,4}$|^\d{4}(?:-\d\d){2}$"
NO_TITLE = tuple("document/document1/new document/title/untitled/untitled document".split("/"))
WINDOW_TITLE = "^microsoft " + _any("powerpoint/word") + " - "
FRAGMENT_END = "[-–:;,]$"

SALUTATION = "(?i)^" + _any("best regards/dear/hello/hi/regards/sincerely/thank you/to whom it may concern/yours " + _any("faithfully/sincerely/truly").replace("|", "\0")).replace("\0", "|") + r"\b"
_CODE = r"[-/\w]*\d[-/\w]*"
REFERENCE_NUMBER = r"(?iU)^(?:" + _any(r"file/no\.?/reference\.?/ref\.?") + r"\s*[#:]?\s*)?" + _CODE + "$"

_PICTURE = _any("chart/diagram/figure/graphic/icon/image/img/logo/no description/photo/pic/picture/screenshot/untitled")
_IMAGE_FILE = r"\." + _any("bmp/eps/gif/jpe?g/png/svg/tiff?/webp") + "$"
PLACEHOLDER = "(?i)" + "|".join([rf"^\s*{_PICTURE}?\s*[ _-]?\d*\s*$", _IMAGE_FILE, r"^img[-_]?\d+", r"^\d+$", r"\\[a-z]+\{", "<math", r"^\s*[{\[(]"])

_SIGNS = "*#§¶†‡"
_OPEN, _CLOSE = r"[(\[]?", r"[)\]]?"
MARKER = r"(?i)^\s*" + _OPEN + r"\s*(?:\d{1,3}|[clivx]{1,6}|[a-z]|[" + _SIGNS + r"]+)\s*" + _CLOSE + r"\s*$"
LABEL = rf"(?U)^({_OPEN}[{_SIGNS}\w]{{1,4}}{_CLOSE})"
LABELLED = rf"(?U)^\s*{_OPEN}[{_SIGNS}\w]{{1,4}}{_CLOSE}[-\s:.)]"
NO_MARK = rf"(?U)[^{_SIGNS}\w]"
FORMULA_SOURCE = "|".join([r"\\[A-Za-z]+", r"[_^]\{", r"\$[^$]+\$", "<m(?:ath|row|i>)"])

_WEB, _WWW, _MAIL = r"https?:/{2}\S+", r"w{3}(?:\.[a-z\d-]+)\.[a-z][a-z]+\S*", r"(?U:[+\w.-]+@[-\w]+\.[-\w.]+)\.?"
ADDRESS = f"(?i)({_WEB}|{_WWW}|{_MAIL})"
_GLUE = r"[- _]?\d*"
GENERATED = "(?i)^(?:" + _any("button/check ?box/check/combo/field/fill/list/radio/text/untitled") + _GLUE + "|" + _any("date/name/signature") + r"[- _]?\d+)$"

_COUNT = r"\d{1,4}"
BARE_NUMBER = rf"(?i)^\s*(?:page\s*)?{_COUNT}(?:\s*(?:/|of)\s*{_COUNT})?\s*$"
NUMBERISH = r"^[-–—\s\d.,:/|%()•·$£€₹]*$"
HEADING = "^H([1-9][0-9]*)?$"
