"""Options from INI files."""

from __future__ import annotations

import configparser


def _value(text: str) -> int | float | bool | str:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text.lower(), text)


def read_config(text: str) -> dict[str, dict[str, int | float | bool | str]]:
    """Sections of an INI text with numbers and truth values as such."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.read_string(text)
    return {s: {k: _value(v) for k, v in parser.items(s)} for s in parser.sections()}
