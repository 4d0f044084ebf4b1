"""Charts of a report as inline pictures: their rows are few, so they are drawn on the driver."""

from __future__ import annotations

import html as escaping
import math

WIDTH, LEFT, COLORS = 840, 260, ("#3b6ea5", "#b5533c", "#4d8c57", "#8a5fa8", "#a88a3b", "#5f5f5f")
SURE = {"Worse": "#b5533c", "Resolved": "#4d8c57", "Improved": "#4d8c57"}


def _text(x: float, y: float, said: str, anchor: str = "start", color: str = "#222") -> str:
    return f'<text x="{x:.0f}" y="{y:.0f}" text-anchor="{anchor}" fill="{color}">{escaping.escape(said)}</text>'


def _picture(height: float, label: str, body: str) -> str:
    return f'<svg width="{WIDTH}" height="{height:.0f}" role="img" aria-label="{escaping.escape(label)}" font-size="13">{body}</svg>'


def bars(rows: list[dict]) -> str:
    """Priority scores, one bar a theme: name, score."""
    body = "".join(_text(0, 24 * k + 16, r["name"][:48]) + f'<rect x="380" y="{24 * k + 4}" width="{4 * r["score"]:.0f}" height="16" fill="{COLORS[0]}"/>' + _text(386 + 4 * r["score"], 24 * k + 16, f"{r['score']:.0f}") for k, r in enumerate(rows))
    return _picture(24 * len(rows) + 8, "Priority scores", body)


def slopes(rows: list[dict]) -> str:
    """Ranks by mentions on the left, by priority on the right: name, vote_rank, rank."""
    most = max([1, *[max(r["vote_rank"], r["rank"]) for r in rows]])
    y = lambda rank: 40 + 18 * (rank - 1)
    body = _text(LEFT, 18, "by mentions", "end") + _text(WIDTH - LEFT, 18, "by priority")
    for k, r in enumerate(rows):
        color = COLORS[k % len(COLORS)]
        body += f'<line x1="{LEFT + 8}" y1="{y(r["vote_rank"])}" x2="{WIDTH - LEFT - 8}" y2="{y(r["rank"])}" stroke="{color}" stroke-width="2"/>'
        body += _text(LEFT, y(r["vote_rank"]) + 4, f"#{r['vote_rank']}", "end", color) + _text(WIDTH - LEFT, y(r["rank"]) + 4, f"#{r['rank']} {r['name'][:30]}", "start", color)
    return _picture(y(most) + 24, "Ranks by mentions and by priority", body)


def lines(rows: list[dict], names: dict[str, str]) -> str:
    """Weekly shares of all feedback: theme_id, week, percent."""
    weeks, top = sorted({r["week"] for r in rows}), max([1e-9, *[r["percent"] or 0 for r in rows]])
    x = lambda w: 50 + (WIDTH - 300) * weeks.index(w) / max(1, len(weeks) - 1)
    y = lambda p: 210 - 180 * p / top
    body = _text(44, 30, f"{top:.0f}%", "end") + _text(44, 214, "0", "end") + (_text(50, 234, str(weeks[0])) + _text(WIDTH - 250, 234, str(weeks[-1]), "end") if weeks else "")
    for k, theme in enumerate(sorted({r["theme_id"] for r in rows})):
        color, mine = COLORS[k % len(COLORS)], sorted((r for r in rows if r["theme_id"] == theme), key=lambda r: r["week"])
        points = " ".join(f"{x(r['week']):.0f},{y(r['percent'] or 0):.0f}" for r in mine)
        body += f'<polyline points="{points}" fill="none" stroke="{color}" stroke-width="2"/>' + _text(WIDTH - 240, 30 + 18 * k, names.get(theme, theme)[:32], "start", color)
    return _picture(max(244, 40 + 18 * len({r["theme_id"] for r in rows})), "Share of feedback by week", body)


def intervals(rows: list[dict]) -> str:
    """Rate ratios around releases on a log scale with their intervals: version, rate_ratio, ci_low, ci_high, verdict."""
    low, high = 0.05, 20.0
    x = lambda v: LEFT + (WIDTH - LEFT - 40) * (math.log(min(max(v, low), high)) - math.log(low)) / math.log(high / low)
    body = f'<line x1="{x(1):.0f}" y1="20" x2="{x(1):.0f}" y2="{34 + 26 * len(rows)}" stroke="#999" stroke-dasharray="4"/>' + "".join(_text(x(v), 14, f"x{v:g}", "middle") for v in (0.1, 0.5, 1, 2, 10))
    for k, r in enumerate(rows):
        y, color = 40 + 26 * k, SURE.get(r["verdict"], "#777")
        body += _text(0, y + 4, f"{r['version']}: {r['verdict']}"[:38]) + f'<line x1="{x(r["ci_low"]):.0f}" y1="{y}" x2="{x(r["ci_high"]):.0f}" y2="{y}" stroke="{color}" stroke-width="3"/><circle cx="{x(r["rate_ratio"]):.0f}" cy="{y}" r="5" fill="{color}"/>'
    return _picture(44 + 26 * len(rows), "Rate change after releases", body)
