"""Plain Python spellings shared by the tests."""

import re

from funnelspark.llm.common import SPACES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def line_key(line):
    return line.strip(SPACES).translate(LOWER)
