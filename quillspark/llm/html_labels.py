"""Labelled text blocks: words and link density of the block before, the block and the block after; 1 for content."""

TABLE = (
    (0, 0, 1, 1, 1, 1, 0),
    (1, 0, 1, 0, 37, 0, 1),
    (1, 0, 37, 0, 9, 0, 1),
    (1, 0, 77, 0, 37, 0, 1),
    (1, 1, 1, 1, 1, 1, 0),
    (1, 1, 1, 1, 4, 0, 0),
    (1, 1, 1, 1, 5, 0, 0),
    (1, 1, 1, 1, 6, 0, 0),
    (1, 1, 1, 1, 9, 0, 0),
    (1, 1, 4, 0, 10, 0, 0),
    (1, 1, 5, 0, 2, 0, 0),
    (1, 1, 5, 0, 7, 0, 0),
    (1, 1, 7, 0, 8, 0, 0),
    (1, 1, 8, 0, 4, 0, 0),
    (1, 1, 9, 0, 7, 0, 0),
    (1, 1, 10, 0, 8, 0, 0),
    (1, 1, 11, 0, 11, 0, 0),
    (1, 1, 12, 0, 1, 0, 0),
    (2, 0, 1, 0, 15, 0, 1),
    (2, 0, 8, 0, 0, 0, 0),
    (2, 0, 11, 0, 0, 0, 0),
    (3, 0, 3, 0, 11, 0, 1),
    (4, 0, 4, 0, 8, 0, 1),
    (4, 0, 4, 0, 47, 0, 1),
    (4, 0, 7, 0, 22, 0, 1),
    (5, 0, 2, 0, 2, 0, 1),
    (5, 0, 5, 0, 30, 0, 1),
    (5, 0, 7, 0, 7, 0, 1),
    (5, 0, 8, 0, 9, 0, 1),
    (5, 0, 10, 0, 172, 0, 1),
    (6, 0, 10, 0, 15, 0, 1),
    (6, 0, 11, 0, 20, 0, 1),
    (7, 0, 3, 0, 7, 0, 1),
    (7, 0, 11, 0, 88, 0, 1),
    (7, 0, 12, 0, 29, 0, 1),
    (7, 0, 22, 0, 33, 0, 1),
    (8, 0, 4, 0, 4, 0, 1),
    (8, 0, 12, 0, 0, 0, 0),
    (9, 0, 12, 0, 160, 0, 1),
    (10, 0, 9, 0, 9, 0, 1),
    (10, 0, 10, 0, 172, 0, 1),
    (11, 0, 5, 0, 5, 0, 1),
    (11, 0, 17, 0, 143, 0, 1),
    (11, 0, 49, 0, 176, 0, 1),
    (11, 0, 88, 0, 35, 0, 1),
    (11, 0, 149, 0, 46, 0, 1),
    (13, 0, 12, 0, 35, 0, 1),
    (14, 0, 13, 0, 29, 0, 1),
    (14, 0, 15, 0, 0, 0, 0),
    (15, 0, 67, 0, 25, 0, 1),
    (17, 0, 8, 0, 19, 0, 1),
    (17, 0, 60, 0, 112, 0, 1),
    (17, 0, 92, 0, 7, 0, 1),
    (19, 0, 9, 0, 20, 0, 1),
    (20, 0, 1, 0, 1, 0, 1),
    (20, 0, 4, 0, 15, 0, 1),
    (20, 0, 8, 0, 8, 0, 1),
    (20, 0, 13, 0, 0, 0, 0),
    (21, 0, 7, 0, 0, 0, 0),
    (21, 0, 103, 0, 10, 0, 1),
    (21, 0, 114, 0, 10, 0, 1),
    (22, 0, 16, 0, 0, 0, 0),
    (22, 0, 33, 0, 30, 0, 1),
    (23, 0, 89, 0, 13, 0, 1),
    (24, 0, 61, 0, 22, 0, 1),
    (25, 0, 29, 0, 17, 0, 1),
    (25, 0, 32, 0, 13, 0, 1),
    (27, 0, 15, 0, 46, 0, 1),
    (30, 0, 14, 0, 37, 0, 1),
    (30, 0, 31, 0, 31, 0, 1),
    (30, 0, 37, 0, 47, 0, 1),
    (31, 0, 1, 0, 9, 0, 1),
    (31, 0, 1, 0, 37, 0, 1),
    (31, 0, 25, 0, 23, 0, 1),
    (31, 0, 31, 0, 31, 0, 1),
    (31, 0, 61, 0, 38, 0, 1),
    (31, 0, 189, 0, 43, 0, 1),
    (32, 0, 46, 0, 1, 0, 1),
    (32, 0, 52, 0, 25, 0, 1),
    (36, 0, 38, 0, 78, 0, 1),
    (37, 0, 2, 0, 59, 0, 1),
    (37, 0, 17, 0, 13, 0, 1),
    (38, 0, 36, 0, 28, 0, 1),
    (38, 0, 42, 0, 47, 0, 1),
    (43, 0, 33, 0, 15, 0, 1),
    (46, 0, 25, 0, 12, 0, 1),
    (47, 0, 2, 0, 1, 0, 1),
    (47, 0, 239, 0, 66, 0, 1),
    (49, 0, 176, 0, 8, 0, 1),
    (51, 0, 7, 0, 57, 0, 1),
    (51, 0, 22, 0, 15, 0, 1),
    (52, 0, 25, 0, 11, 0, 1),
    (58, 0, 27, 0, 15, 0, 1),
    (60, 0, 112, 0, 100, 0, 1),
    (65, 0, 13, 0, 6, 0, 1),
    (66, 0, 18, 0, 113, 0, 1),
    (76, 0, 7, 0, 0, 0, 0),
    (78, 0, 92, 0, 46, 0, 1),
    (83, 0, 5, 0, 81, 0, 1),
    (92, 0, 46, 0, 167, 0, 1),
    (97, 0, 1, 0, 29, 0, 1),
    (103, 0, 10, 0, 0, 0, 0),
    (112, 0, 100, 0, 83, 0, 1),
    (113, 0, 25, 0, 13, 0, 1),
    (113, 0, 30, 0, 58, 0, 1),
    (117, 0, 32, 0, 46, 0, 1),
    (117, 0, 113, 0, 30, 0, 1),
    (132, 0, 117, 0, 113, 0, 1),
    (135, 0, 7, 0, 7, 0, 1),
    (149, 0, 46, 0, 1, 0, 1),
    (0, 0, 1, 1, 0, 0, 0),
    (0, 0, 1, 1, 2, 1, 0),
    (0, 0, 1, 1, 40, 0, 0),
    (0, 0, 3, 1, 0, 0, 0),
    (0, 0, 3, 1, 2, 1, 0),
    (0, 0, 3, 1, 40, 0, 0),
    (0, 0, 12, 0.85, 0, 0, 0),
    (0, 0, 12, 0.85, 2, 1, 0),
    (0, 0, 12, 0.85, 40, 0, 0),
    (0, 0, 22, 0, 0, 0, 1),
    (0, 0, 22, 0, 1, 1, 1),
    (0, 0, 22, 0, 45, 0, 1),
    (0, 0, 30, 0.85, 0, 0, 0),
    (0, 0, 30, 0.85, 2, 1, 0),
    (0, 0, 30, 0.85, 40, 0, 0),
    (0, 0, 35, 0.1, 0, 0, 1),
    (0, 0, 35, 0.1, 1, 1, 1),
    (0, 0, 35, 0.1, 45, 0, 1),
    (0, 0, 60, 0, 0, 0, 1),
    (0, 0, 60, 0, 1, 1, 1),
    (0, 0, 60, 0, 45, 0, 1),
    (0, 0, 70, 0.85, 0, 0, 0),
    (0, 0, 70, 0.85, 2, 1, 0),
    (0, 0, 70, 0.85, 40, 0, 0),
    (0, 0, 140, 0, 0, 0, 1),
    (0, 0, 140, 0, 1, 1, 1),
    (0, 0, 140, 0, 45, 0, 1),
    (2, 1, 1, 1, 0, 0, 0),
    (2, 1, 1, 1, 2, 1, 0),
    (2, 1, 1, 1, 40, 0, 0),
    (2, 1, 3, 1, 0, 0, 0),
    (2, 1, 3, 1, 2, 1, 0),
    (2, 1, 3, 1, 40, 0, 0),
    (2, 1, 12, 0.85, 0, 0, 0),
    (2, 1, 12, 0.85, 2, 1, 0),
    (2, 1, 12, 0.85, 40, 0, 0),
    (2, 1, 30, 0.85, 0, 0, 0),
    (2, 1, 30, 0.85, 2, 1, 0),
    (2, 1, 30, 0.85, 40, 0, 0),
    (2, 1, 70, 0.85, 0, 0, 0),
    (2, 1, 70, 0.85, 2, 1, 0),
    (2, 1, 70, 0.85, 40, 0, 0),
    (3, 0, 22, 0, 0, 0, 1),
    (3, 0, 22, 0, 1, 1, 1),
    (3, 0, 22, 0, 45, 0, 1),
    (3, 0, 35, 0.1, 0, 0, 1),
    (3, 0, 35, 0.1, 1, 1, 1),
    (3, 0, 35, 0.1, 45, 0, 1),
    (3, 0, 60, 0, 0, 0, 1),
    (3, 0, 60, 0, 1, 1, 1),
    (3, 0, 60, 0, 45, 0, 1),
    (3, 0, 140, 0, 0, 0, 1),
    (3, 0, 140, 0, 1, 1, 1),
    (3, 0, 140, 0, 45, 0, 1),
    (4, 1, 22, 0, 0, 0, 1),
    (4, 1, 22, 0, 1, 1, 1),
    (4, 1, 22, 0, 45, 0, 1),
    (4, 1, 35, 0.1, 0, 0, 1),
    (4, 1, 35, 0.1, 1, 1, 1),
    (4, 1, 35, 0.1, 45, 0, 1),
    (4, 1, 60, 0, 0, 0, 1),
    (4, 1, 60, 0, 1, 1, 1),
    (4, 1, 60, 0, 45, 0, 1),
    (4, 1, 140, 0, 0, 0, 1),
    (4, 1, 140, 0, 1, 1, 1),
    (4, 1, 140, 0, 45, 0, 1),
    (12, 0.8, 22, 0, 0, 0, 1),
    (12, 0.8, 22, 0, 1, 1, 1),
    (12, 0.8, 22, 0, 45, 0, 1),
    (12, 0.8, 35, 0.1, 0, 0, 1),
    (12, 0.8, 35, 0.1, 1, 1, 1),
    (12, 0.8, 35, 0.1, 45, 0, 1),
    (12, 0.8, 60, 0, 0, 0, 1),
    (12, 0.8, 60, 0, 1, 1, 1),
    (12, 0.8, 60, 0, 45, 0, 1),
    (12, 0.8, 140, 0, 0, 0, 1),
    (12, 0.8, 140, 0, 1, 1, 1),
    (12, 0.8, 140, 0, 45, 0, 1),
    (40, 0, 1, 1, 0, 0, 0),
    (40, 0, 1, 1, 2, 1, 0),
    (40, 0, 1, 1, 40, 0, 0),
    (40, 0, 3, 1, 0, 0, 0),
    (40, 0, 3, 1, 2, 1, 0),
    (40, 0, 3, 1, 40, 0, 0),
    (40, 0, 12, 0.85, 0, 0, 0),
    (40, 0, 12, 0.85, 2, 1, 0),
    (40, 0, 12, 0.85, 40, 0, 0),
    (40, 0, 30, 0.85, 0, 0, 0),
    (40, 0, 30, 0.85, 2, 1, 0),
    (40, 0, 30, 0.85, 40, 0, 0),
    (40, 0, 70, 0.85, 0, 0, 0),
    (40, 0, 70, 0.85, 2, 1, 0),
    (40, 0, 70, 0.85, 40, 0, 0),
    (50, 0, 22, 0, 0, 0, 1),
    (50, 0, 22, 0, 1, 1, 1),
    (50, 0, 22, 0, 45, 0, 1),
    (50, 0, 35, 0.1, 0, 0, 1),
    (50, 0, 35, 0.1, 1, 1, 1),
    (50, 0, 35, 0.1, 45, 0, 1),
    (50, 0, 60, 0, 0, 0, 1),
    (50, 0, 60, 0, 1, 1, 1),
    (50, 0, 60, 0, 45, 0, 1),
    (50, 0, 140, 0, 0, 0, 1),
    (50, 0, 140, 0, 1, 1, 1),
    (50, 0, 140, 0, 45, 0, 1),
)
