"""Hand-written pages for the reading order."""

import random

from quirework.operators.reading import Box, Family, Lines, Region, after_nearest, after_reference, by_radius, by_weight, continues, cut, item_order, misplaced, place, region_order, text_lines, Slot

TEXT, IMAGE, CAPTION, TITLE, DOC, HEADER, FOOTNOTE, ASIDE = 22, 14, 7, 17, 6, 12, 10, 2


def _slots(*boxes):
    return [Slot(Box(*b), Region(i, TEXT, Box(*b))) for i, b in enumerate(boxes)]


def test_lines_join_what_shares_their_height():
    lines = text_lines([Box(0, 0, 50, 10), Box(60, 3, 100, 13), Box(0, 20, 90, 30)])
    assert lines == Lines(True, 2, 11, 95, 0, 90)
    assert text_lines([]) == Lines()


def test_lines_that_run_downwards_go_from_right_to_left():
    lines = text_lines([Box(0, 5, 10, 100), Box(30, 0, 40, 90), Box(31, 92, 41, 120)])
    assert lines == Lines(False, 2, 107, 10, 0, 100)


def test_half_of_the_boxes_decide_the_direction():
    assert text_lines([Box(0, 0, 10, 100), Box(0, 0, 100, 10)]).across
    assert not text_lines([Box(0, 0, 10, 100), Box(20, 0, 30, 100), Box(0, 0, 100, 10)]).across


def test_no_layout_means_top_to_bottom():
    items = [Box(0, 50, 10, 60), Box(100, 0, 110, 10), Box(0, 0, 10, 10)]
    assert item_order(items, [-1] * 3, []) == [2, 1, 0]
    assert item_order([], [], []) == []


def test_few_items_in_regions_mean_top_to_bottom():
    items = [Box(0, 1000 - 10 * i, 10, 1008 - 10 * i) for i in range(60)]
    region = Region(0, TEXT, Box(0, 1000, 10, 1010))
    assert item_order(items, [0, 0] + [-1] * 58, [region]) == list(range(59, -1, -1))


def test_strata_then_columns_then_rows():
    regions = [Region(0, 8, Box(0, 0, 100, 20)), Region(1, TEXT, Box(300, 100, 500, 400)), Region(2, TEXT, Box(0, 100, 200, 400)), Region(3, HEADER, Box(0, 900, 100, 920))]
    assert region_order(regions) == [3, 2, 1, 0]
    items = [Box(300, 100, 400, 110), Box(0, 102, 50, 112), Box(60, 100, 90, 110), Box(0, 5, 50, 15), Box(0, 905, 50, 915), Box(0, 200, 90, 210)]
    assert item_order(items, [1, 2, 2, 0, 3, 2], regions) == [4, 1, 2, 5, 0, 3]


def test_items_outside_all_regions_keep_their_place():
    regions = [Region(0, TEXT, Box(0, 0, 200, 50)), Region(1, TEXT, Box(0, 200, 200, 250))]
    items = [Box(0, 210, 90, 220), Box(0, 100, 90, 110), Box(0, 10, 90, 20)]
    assert item_order(items, [1, -1, 0], regions) == [2, 1, 0]


def test_references_go_after_what_reaches_farthest_right_above():
    slots = _slots((0, 0, 100, 10), (200, 0, 300, 10), (0, 50, 100, 60))
    assert after_reference(slots, Box(0, 20, 10, 30)) == 2
    assert after_reference(slots, Box(0, 5, 10, 9)) == 1


def test_asides_go_after_the_nearest_corner_and_the_first_wins_ties():
    slots = _slots((0, 0, 10, 10), (20, 0, 30, 10))
    assert after_nearest(slots, Box(10, 0, 12, 2)) == 1
    assert after_nearest(slots, Box(15, 0, 17, 2)) == 2
    assert by_radius(slots, Box(8, 0, 18, 10)) == 1
    assert by_radius(slots, Box(80, 0, 88, 10)) == 2


def test_titles_go_before_the_block_below_them():
    slots = _slots((0, 0, 100, 50), (0, 100, 100, 150))
    assert by_weight(slots, Region(9, TITLE, Box(0, 80, 100, 95)), True, 0) == 1
    assert by_weight(slots, Region(9, DOC, Box(0, -40, 100, -20)), True, 20) == 0
    assert by_weight(slots, Region(9, IMAGE, Box(0, 160, 100, 300)), True, 0) == 2


def test_a_figure_does_not_part_a_paragraph():
    lines = Lines(True, 3, 10, 100, 0, 100)
    slots = [Slot(b, Region(i, TEXT, b, lines)) for i, b in enumerate([Box(0, 0, 100, 50), Box(0, 100, 100, 150), Box(0, 300, 100, 350)])]
    assert continues(slots[1].region, slots[0].region, True)
    assert by_weight(slots, Region(9, IMAGE, Box(0, 51, 100, 90)), True, 0) == 2
    assert by_weight(slots, Region(9, IMAGE, Box(0, 55, 100, 90)), True, 0) == 0
    assert not continues(slots[1].region, slots[0].region, False)
    assert not continues(slots[1].region, Region(0, TEXT, Box(0, 0, 140, 50), lines), True)


def test_the_title_is_placed_before_other_insertions():
    slots: list[Slot] = []
    for r in sorted([Region(0, ASIDE, Box(50, 50, 60, 60)), Region(1, DOC, Box(0, 0, 100, 20))], key=lambda r: r.class_id != DOC):
        place(slots, r, True, 0)
    assert [s.region.number for s in slots] == [1, 0]


def test_captions_belong_to_their_figure():
    regions = [Region(0, IMAGE, Box(0, 100, 200, 300)), Region(1, CAPTION, Box(10, 305, 190, 320)), Region(2, TEXT, Box(0, 325, 90, 340), Lines(True, 1, 15, 90, 0, 90)), Region(3, TEXT, Box(0, 400, 300, 700))]
    assert {c.number: p.number for c, p in Family(regions, 15).owner.items()} == {1: 0, 2: 0}
    assert not Family(regions, 0).owner


def test_lower_titles_belong_to_the_title_above_and_are_no_parents():
    regions = [Region(i, TITLE, Box(0, 20 * i, 100, 20 * i + 15)) for i in range(3)]
    family = Family(regions, 15)
    assert {c.number: p.number for c, p in family.owner.items()} == {1: 0}
    regions = [Region(0, DOC, Box(0, 0, 400, 60)), Region(1, TEXT, Box(100, 70, 250, 85), Lines(True, 1, 15, 150, 100, 250))]
    assert {c.number: p.number for c, p in Family(regions, 15).owner.items()} == {1: 0}


def test_descendants_come_by_height_and_once():
    a, b, c, d = (Region(i, TEXT, Box(0, y, 10, y + 5)) for i, y in enumerate((0, 30, 10, 20)))
    a.children, c.children, d.children = [b, c], [d], [a, c]
    assert [r.number for r in Family.below(a)] == [2, 3, 1]


def test_pages_that_run_downwards_are_cut_from_right_to_left():
    slots = _slots((0, 0, 50, 100), (100, 0, 150, 100))
    assert [s.region.number for s in cut(slots, across=False)] == [1, 0]
    assert [s.region.number for s in cut(_slots((5, 5, 5, 5), (0, 0, 10, 10)))] == [1, 0]


def test_every_item_comes_once():
    rng = random.Random(4)
    box = lambda: (lambda x, y: Box(x, y, x + rng.randint(0, 200), y + rng.randint(0, 80)))(rng.randint(-20, 600), rng.randint(0, 900))
    for _ in range(200):
        regions = [Region(i, rng.choice([-1, *range(25)]), box()) for i in range(rng.randint(0, 8))]
        items = [box() for _ in range(rng.randint(0, 40))]
        held = [rng.randint(-1, 9) for _ in items]
        assert sorted(item_order(items, held, regions)) == list(range(len(items)))
        assert sorted(region_order(regions)) == list(range(len(regions)))


def test_misplaced_rows():
    boxes = [Box(0, 0, 5, 5), Box(10, 2, 15, 7), Box(0, 20, 5, 25)]
    assert misplaced(boxes, 3) == []
    assert misplaced([boxes[1], boxes[0], boxes[2]], 3) == [0, 1]
