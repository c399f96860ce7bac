"""Closed vocabularies of the measurement."""

from __future__ import annotations

# Names that results and files carry.
ATTACK, BENIGN = "attack", "benign"
BENIGN_CLASSES = ("b_code", "b_chat")
RAW, CANONICAL = "raw", "canonical"
BOUND, HELD_OUT = "bound", "held_out"
ALL_ITEMS, SINGLE_WINDOW = "all", "single_window"
STAGES = ("invisible", "confusables", "nfkc", "decode")
DECODE, DECODE_CEILING = "decode", "decode-ceiling"
TRACE_LABELS = (*STAGES, DECODE_CEILING)
CEILING = 3
CLEAN, CHAIN_SEPARATOR, ID_SEPARATOR = "clean", "+", "::"
WILSON, NEWCOMBE, MOVER = "wilson-score", "newcombe-paired-score", "mover-difference"
AUC_METHOD, DELTA_AUC_METHOD = "auc-structural-components", "delta-auc-structural-components"

# Code points that canonicalization deletes, zero-width ones and directional controls.
INVISIBLE = (
    "\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
    "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
)

# Greek and Cyrillic code points that are confusable with ASCII (Unicode security data 15.1.0).
CONFUSABLE = {
    0x0374: "'", 0x037A: "i", 0x037E: ";", 0x037F: "J", 0x0384: "'", 0x0391: "A", 0x0392: "B", 0x0395: "E", 0x0396: "Z",
    0x0397: "H", 0x0399: "l", 0x039A: "K", 0x039C: "M", 0x039D: "N", 0x039F: "O", 0x03A1: "P", 0x03A4: "T", 0x03A5: "Y",
    0x03A7: "X", 0x03B1: "a", 0x03B3: "y", 0x03B9: "i", 0x03BD: "v", 0x03BF: "o", 0x03C1: "p", 0x03C3: "o", 0x03C5: "u",
    0x03D2: "Y", 0x03DC: "F", 0x03E8: "2", 0x03F1: "p", 0x03F2: "c", 0x03F3: "j", 0x03F9: "C", 0x03FA: "M", 0x0405: "S",
    0x0406: "l", 0x0408: "J", 0x0410: "A", 0x0412: "B", 0x0415: "E", 0x0417: "3", 0x041A: "K", 0x041C: "M", 0x041D: "H",
    0x041E: "O", 0x0420: "P", 0x0421: "C", 0x0422: "T", 0x0423: "Y", 0x0425: "X", 0x042B: "bl", 0x042C: "b", 0x042E: "lO",
    0x0430: "a", 0x0431: "6", 0x0433: "r", 0x0435: "e", 0x043E: "o", 0x0440: "p", 0x0441: "c", 0x0443: "y", 0x0445: "x",
    0x0455: "s", 0x0456: "i", 0x0458: "j", 0x0461: "w", 0x0474: "V", 0x0475: "v", 0x0491: "r'", 0x04AE: "Y", 0x04AF: "y",
    0x04BB: "h", 0x04BD: "e", 0x04C0: "l", 0x04CF: "i", 0x04D4: "AE", 0x04D5: "ae", 0x04E0: "3", 0x0501: "d", 0x050C: "G",
    0x051B: "q", 0x051C: "W", 0x051D: "w", 0x1FBD: "'", 0x1FBE: "i", 0x1FBF: "'", 0x1FC0: "~", 0x1FEF: "'", 0x1FFD: "'",
    0x1FFE: "'", 0xA644: "2", 0xA647: "i", 0xA698: "OO", 0xA699: "oo",
}

# The encoding chains, first link innermost; the empty chain is "clean".
BOUND_CHAINS = (
    (), ("base64",), ("hex",), ("homoglyph",), ("zero_width",),
    ("base64", "base64"), ("zero_width", "base64"), ("base64", "homoglyph"), ("hex", "zero_width"),
    ("base64", "base64", "base64", "base64"),
)
HELD_OUT_CHAINS = (("base32",), ("url_percent",), ("rot13",))
CHAINS = BOUND_CHAINS + HELD_OUT_CHAINS
DECODED_LINKS = ("base64", "hex")
# What the canonicalizer can engage a held-out encoding with.
PROBES = {"base32": "decode", "url_percent": "partial", "rot13": "none"}

# Shortest run and least entropy (bits a character) of a decode candidate.
HEX_CHARS, HEX_ENTROPY = 16, 2.5
BASE64_CHARS, BASE64_ENTROPY = 24, 3.0

# Statistics and thresholds of findings and verdicts.
Z95 = 1.959963984540054
TIE_SHARE = 0.05
LAYER_SHARE, LAYER_CEILING_NS = 0.10, 1_000_000
OVERLAP_RATIO, SHINGLE = 0.85, 5
