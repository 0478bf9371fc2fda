"""Scoring requests as they arrive."""

from countcast.streaming.requests import answer_stream, request_stream, score_stream, start_scoring, unique_requests
from countcast.streaming.totals import current_means, current_totals, fact_stream, mean_measures, start_totals, total_measures

__all__ = ["answer_stream", "current_means", "current_totals", "fact_stream", "mean_measures", "request_stream", "score_stream", "start_scoring", "start_totals", "total_measures", "unique_requests"]
