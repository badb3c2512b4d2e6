"""Spark-first generation and analysis of synthetic spatial networks."""

from geoweft.operators.attachment import geo_barabasi_albert_network
from geoweft.operators.export import graph_to_gdf, graph_to_tables
from geoweft.operators.frame import GeoFrame, GeoGraph, exploded, to_crs
from geoweft.operators.ordering import attribute_order, density_order, density_order_kde, density_order_knn, random_order
from geoweft.operators.random_graph import geo_erdos_renyi_network
from geoweft.operators.shared import release
from geoweft.operators.small_world import geo_watts_strogatz_network
from geoweft.sources.sampling import sample_points, sample_within

__all__ = [
    "GeoFrame", "GeoGraph", "attribute_order", "density_order", "density_order_kde", "density_order_knn", "exploded", "geo_barabasi_albert_network",
    "geo_erdos_renyi_network", "geo_watts_strogatz_network", "graph_to_gdf", "graph_to_tables", "random_order", "release", "sample_points", "sample_within", "to_crs",
]
