"""Boundary-effect analytics on Spark: distances to a sample's border, graphs, centralities, response curves and corrected scores."""

from rimward.centrality import MEASURES, centralities
from rimward.distances import (
    distance_to_alpha_shape,
    distance_to_convex_hull,
    distance_to_mask,
    distance_to_pointset,
    distance_to_rectangular_border,
)
from rimward.flow import Flow, FlowResult, corrected_scores, fit_correct
from rimward.free_curves import FreeCurve
from rimward.graph import construct_graph, delaunay_edges, knn_edges, rnn_edges
from rimward.models import CONSTANT, DEFAULT_MODELS, EXPONENTIAL, MICHAELIS, PIECEWISE, CurveModel, fit_models
from rimward.selection import ranked_fits

__all__ = [
    "CONSTANT", "DEFAULT_MODELS", "EXPONENTIAL", "MEASURES", "MICHAELIS", "PIECEWISE", "CurveModel", "Flow", "FlowResult", "FreeCurve", "centralities", "construct_graph", "corrected_scores",
    "delaunay_edges", "distance_to_alpha_shape", "distance_to_convex_hull", "distance_to_mask", "distance_to_pointset", "distance_to_rectangular_border", "fit_correct", "fit_models", "knn_edges",
    "ranked_fits", "rnn_edges",
]
