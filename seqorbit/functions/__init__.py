"""Column-expression building blocks (board geometry, symmetry, rule checks)."""

from .board import (  # noqa: F401
    DEFAULT_BOARD, KNIGHT_OFFSETS, TOUR_TYPE, Board, all_in_board, canonical,
    canonical_full, canonical_symmetry, first_illegal_step, free_degree, in_board,
    is_closed, is_complete, is_legal, is_step, is_unique, is_valid_tour, key_prefix,
    n_illegal_steps, onward_moves, square_image, square_image_by, tour_image,
    tour_image_by, tour_images, tour_key, with_canonical, square_image_arith,
)
