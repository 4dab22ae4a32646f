"""How many tasks the checks of predictions are dealt over."""
from gapcube.operators.validate import tasks_for


def test_tasks_stay_small_and_their_shuffle_unsorted():
    assert tasks_for(900_000, 12) == 12
    assert tasks_for(9_000_000, 12) == 69  # 9 tasks of a million rows before
    assert tasks_for(54_000_000, 12) == 200
    assert tasks_for(324_000_000, 12) == 200  # about 6 GB: 309 before, whose writers hold their rows
    assert tasks_for(4_200_000_000, 12) == 2003  # no task grows without end


def test_a_larger_setting_stays():
    assert tasks_for(10, 400) == 400
