"""Jobs from file to file, as a user of the tools runs them."""

import os

import pytest

from rookery import jobs

ALPHA = '[Event "Alpha Open"]\n[Site "Rome"]\n[Date "2024.01.02"]\n[Round "1"]\n[White "Alice"]\n[Black "Bob"]\n[WhiteElo "2500"]\n[BlackElo "2400"]\n[Result "1-0"]\n[ECO "C20"]\n\n1. e4 e5 2. Qh5 Nc6 3. Bc4 Nf6 4. Qxf7# 1-0\n'
BETA = '[Event "Beta Open"]\n[Site "Oslo"]\n[Date "2024.02.03"]\n[Round "2"]\n[White "Carol"]\n[Black "Dan"]\n[WhiteElo "2300"]\n[BlackElo "2200"]\n[Result "1/2-1/2"]\n\n1. d4 {quiet} d5 (1... Nf6 $1) 2. c4 e6 1/2-1/2\n'


@pytest.fixture
def at(tmp_path):
    (tmp_path / "in.pgn").write_text(BETA + "\n" + ALPHA)
    (tmp_path / "twice.pgn").write_text(ALPHA + "\n\n" + ALPHA)
    return str(tmp_path)


def text(at, name):
    with open(f"{at}/{name}", encoding="utf-8") as f:
        return f.read()


def test_filters_count(spark, at):
    assert jobs.filter_file(spark, f"{at}/in.pgn", f"{at}/f.pgn", min_elo=2400, require_both=True) == {"processed": 2, "kept": 1, "removed": 1}
    assert jobs.checkmates_file(spark, f"{at}/in.pgn", f"{at}/m.pgn")["kept"] == 1
    assert "Qxf7#" in text(at, "m.pgn") and "Beta Open" not in text(at, "m.pgn")
    assert jobs.deduplicate_file(spark, f"{at}/twice.pgn", f"{at}/d.pgn") == {"processed": 2, "kept": 1, "removed": 1}


def test_sort_split_and_join(spark, at):
    assert jobs.sort_file(spark, f"{at}/in.pgn", f"{at}/s.pgn", ["White"]) == {"processed": 2, "kept": 2}
    assert text(at, "s.pgn").index("Alice") < text(at, "s.pgn").index("Carol")
    assert jobs.split_file(spark, f"{at}/in.pgn", f"{at}/split") == {"games": 2, "files": 2}
    assert sorted(os.listdir(f"{at}/split")) == ["Alpha Open.pgn", "Beta Open.pgn"]
    assert jobs.split_file(spark, f"{at}/in.pgn", f"{at}/months", "Date", precision="month")["files"] == 2 and "2024-02.pgn" in os.listdir(f"{at}/months")
    assert jobs.split_file(spark, f"{at}/in.pgn", f"{at}/chunks", "chunk", size=1)["files"] == 2 and "games_chunk_0002.pgn" in os.listdir(f"{at}/chunks")
    sources = [f"{at}/split/{x}.pgn" for x in ("Beta Open", "Alpha Open", "beta open")]
    assert jobs.join_files(spark, sources, f"{at}/j.pgn") == {"games": 2, "files": 2}
    joined = text(at, "j.pgn")
    assert joined.index("Beta Open") < joined.index("Alpha Open") and joined.count("\n\n\n[") == 1


def test_openings_plies_and_marks(spark, at):
    with open(f"{at}/book.pgn", "w") as f:
        f.write('[ECO "C20"]\n[Opening "King\'s Pawn Game"]\n\n1. e4 e5 *\n')
    jobs.tag_openings_file(spark, f"{at}/in.pgn", f"{at}/book.pgn", f"{at}/o.pgn")
    assert text(at, "o.pgn").count("King's Pawn Game") == 1
    jobs.add_ply_counts_file(spark, f"{at}/in.pgn", f"{at}/p.pgn")
    assert '[PlyCount "7"]' in text(at, "p.pgn") and '[PlyCount "4"]' in text(at, "p.pgn")
    jobs.unannotate_file(spark, f"{at}/in.pgn", f"{at}/u.pgn")
    assert "1. d4 d5 2. c4 e6 1/2-1/2" in text(at, "u.pgn")
    assert jobs.break_tournaments_file(spark, f"{at}/in.pgn", f"{at}/t", 2400, 1) == {"processed": 2, "files": 1}
