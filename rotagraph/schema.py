"""Canonical schemas. Vertices of a graph are 0..n-1; undirected edges have u < v.

Loops and repeats: derived graphs drop them; an adjacency list that holds a loop is an
error; the matrix has none; LEDA drops both.
"""

from __future__ import annotations

GRAPHS = "graph_id long, src string, line_no int, n int, m int, base tinyint, directed boolean"
EDGES = "graph_id long, eid int, u int, v int, directed boolean"
ARCS = "graph_id long, arc_id int, eid int, src int, dst int, pos int, dir string"
G6 = "graph_id long, line_no int, g6 string"
CERTIFICATES = (
    "obstruction array<struct<u:int,v:int>>, rotation array<struct<v:int,nbrs:array<int>>>, "
    "vis_v array<struct<v:int,pos:int,start:int,end:int>>, vis_e array<struct<u:int,v:int,pos:int,start:int,end:int>>"
)
VERDICTS = f"graph_id long, cmd string, n int, m int, verdict string, minor_type string, error string, {CERTIFICATES}"
STATS = "src string, cmd string, n int, m int, num_graphs long, num_ok long, num_nonembeddable long, error_flag string, duration double"

OK, NONEMBEDDABLE, ERROR = "OK", "NONEMBEDDABLE", "ERROR"
UND, IN, OUT = "UND", "IN", "OUT"
#: Commands: planar, drawing, outerplanar, and the searches for K2,3, K3,3 and K4.
COMMANDS = {"p": "planarity", "d": "planar drawing", "o": "outerplanarity", "2": "K2,3 search", "3": "K3,3 search", "4": "K4 search"}
